"""Structured Streaming ingestion: appended bytes become numbered frames, and numbered frames become shards.

How much a trigger takes in is bounded at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``); an error in a batch ends the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.plans.layout import ArraySpec, Layout
from gridloom.sources import store

PENDING = pa.schema([("seq", pa.int64()), ("data", pa.large_binary())])


def _pack(parts: dict[int, bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PENDING) as w:
        w.write(pa.record_batch([pa.array(list(parts), pa.int64()), pa.array(list(parts.values()), pa.large_binary())], schema=PENDING))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> dict[int, bytes]:
    if not data:
        return {}
    t = pa.ipc.open_stream(data).read_all()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


def reframe(parts: DataFrame, frame_bytes: int, most_bytes: int = 0) -> DataFrame:
    """(array_key, frame_id, data) of a stream of (array_key, seq, data) byte strings, in the order of ``seq`` (0, 1, ...).

    A part that comes before its turn, in whatever batch, waits for the parts before it; a part whose turn is over fails the query, as does a part
    that goes beyond ``most_bytes`` of a bounded array. Null data is an empty part. The state of a key is its next part and frame, the bytes of its
    unfinished frame (dropped when the stream ends) and the parts that wait.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, n, rest, waiting = state.get if state.exists else (0, 0, b"", b"")
        pending = _unpack(waiting)
        for b in batches:
            for seq, data in zip(b["seq"], b["data"], strict=True):
                if seq < turn or seq in pending:
                    raise ValueError(f"{key[0]}: part {seq} came twice or too late")
                pending[int(seq)] = bytes(data or b"")
        held, size, ids, out = [bytes(rest)], len(rest), [], []
        while turn in pending:
            held.append(pending.pop(turn))
            size += len(held[-1])
            turn += 1
            if most_bytes and n * frame_bytes + size > most_bytes:
                raise ValueError(f"{key[0]}: more bytes than the array holds")
            if size >= frame_bytes:
                data = b"".join(held)
                whole = size // frame_bytes
                out += [data[i * frame_bytes : (i + 1) * frame_bytes] for i in range(whole)]
                ids += range(n, n + whole)
                n, held, size = n + whole, [data[whole * frame_bytes :]], size - whole * frame_bytes
        state.update((turn, n, b"".join(held), _pack(pending) if pending else b""))
        yield pd.DataFrame({"array_key": [key[0]] * len(ids), "frame_id": ids, "data": out})

    out = "array_key string, frame_id long, data binary"
    return parts.groupBy("array_key").applyInPandasWithState(run, out, "turn long, n long, rest binary, waiting binary", "append", "NoTimeout")


class StoreSink:
    """Writes a stream of (frame_id, data) of one array: full shard layers as they come, the rest by ``finish``.

    A batch's frames go to a folder named after the batch and a layer's files are replaced whole, so a batch that runs again changes nothing.
    """

    def __init__(self, spec: ArraySpec, root: str):
        self.spec, self.root, self.layout = spec, root, Layout(spec)
        self.folder = store.node(root, f".staged/{spec.key or 'root'}")

    def staged(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("frame_id long, data binary").option("recursiveFileLookup", "true").parquet(store.for_spark(f"{self.folder}/batches"))

    def _layers(self) -> int:
        """Layers that are written."""
        fs, at = store.filesystem(f"{self.folder}/done.json")
        if fs.get_file_info(at).size is None:
            return 0
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())["layers"]

    def batch(self, df: DataFrame, batch_id: int) -> None:
        spark, layer = df.sparkSession, self.layout.shard_layer_frames
        df.select("frame_id", "data").write.mode("overwrite").parquet(store.for_spark(f"{self.folder}/batches/{batch_id}"))
        done = self._layers()
        counts = self.staged(spark).groupBy(F.call_function("div", F.col("frame_id"), F.lit(layer)).alias("layer")).agg(F.count_distinct("frame_id").alias("n"))
        full = {r.layer for r in counts.filter((F.col("layer") >= done) & (F.col("n") == layer)).collect()}
        upto = done
        while upto in full:
            upto += 1
        if upto > done:
            self.write(spark, done, upto, upto * layer)

    def write(self, spark: SparkSession, lo: int, hi: int, frames: int) -> None:
        layer = self.layout.shard_layer_frames
        some = self.staged(spark).filter((F.col("frame_id") >= lo * layer) & (F.col("frame_id") < hi * layer)).dropDuplicates(["frame_id"])
        store.write_array(some, self.spec, self.root).collect()  # a row a shard
        store.commit(self.spec, self.root, frames)
        store.put(f"{self.folder}/done.json", json.dumps({"layers": hi}).encode())

    def start(self, frames: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return frames.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def finish(self, spark: SparkSession) -> int:
        """Writes the last layer, however full, removes the staged frames and returns the number of frames."""
        last = self.staged(spark).agg(F.max("frame_id")).first()[0]
        frames = 0 if last is None else last + 1
        done, layer = self._layers(), self.layout.shard_layer_frames
        if frames > done * layer:
            self.write(spark, done, -(-frames // layer), frames)
        fs, at = store.filesystem(self.folder)
        fs.delete_dir(at)
        return frames
