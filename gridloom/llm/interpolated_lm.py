"""A bigram language model with deleted interpolation, trained and applied over whole tables.

P(w | v) = a f(w | v) + b f(w) + c / (V + 1), with maximum-likelihood estimates f and weights (a, b, c) that
depend on the frequency bucket of the context v (powers of two). The weights are learned by expectation
maximisation on counts of a part of the training rows that is deleted from the estimates meanwhile; the final
estimates use all training rows. Tokens are words (A-Z lower-cased) and one end per text; the first word's
context is the text's start, which occurs as often as the end.

How it scales: texts are packed into chunks of about CHUNK bytes, written once to the checkpoint folder. A chunk sends
its distinct n-gram hashes with counts, sorted and delta coded, one blob for each key range; the
owner of a range adds up what all chunks sent and answers each chunk with the totals in the order of
its request. So a frequent n-gram costs one entry per chunk, nothing grows with a single key, and each side holds
one chunk or one key range. N-grams are known by 64-bit hashes. What reaches the driver are sums and the cells
(context bucket by size of the estimates, two cells for each halving down to one in all training tokens) that the weights are learned from:
their number grows with the square of the logarithm of the corpus.

Defined results: null and empty texts are one end token; without training rows all tokens are
unknown and score 1 / (V + 1) = 1; very long texts are scored whole; repeated rows are counted and scored one by one, so there are no
ties; an empty table gives no rows; other columns come back untouched, but those with names of the results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

from ._shared import make_room, materialise

CHUNK, RANGE, PIECE = 8 << 20, 16 << 20, 1 << 19
KEPT, DELETED, UNSEEN = 0, 1, 2
BUCKETS, STEPS = 42, 40
START_KEY, END_KEY = np.uint64(0x5EED0000CAFEF00D), np.uint64(0xE0D0000000000E0D)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(place: np.ndarray) -> np.ndarray:
    """The odd factor of each place in a word."""
    return mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


#: Factors of the first places; longer words compute theirs.
_ODD = _odd(np.arange(64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLANKS = bytes([32, *range(9, 14)])
#: One for blanks, zero for bytes of words.
_EDGES = bytes(c in _BLANKS for c in range(256))
_BREAK = 10


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token keys, keys of each token's context, text index of each token): multilinear hashes of words."""
    whole = b"\n".join([*(t.lower() for t in texts), b""])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # position of each text's closing break
    blank = np.frombuffer(b"\x01" + whole.translate(_EDGES), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begin, n = edges[::2], edges[1::2] - edges[::2]
    if len(begin):
        # words are all that isn't blank, so their bytes in a row need no positions
        data = np.frombuffer(whole.translate(None, _BLANKS), np.uint8)
        start = np.cumsum(n) - n
        within = np.ones(len(data), np.int64)
        within[0], within[start[1:]] = 0, 1 - n[:-1]
        np.cumsum(within, out=within)
        odd = _ODD[within] if n.max() <= len(_ODD) else _odd(within)
        h = np.add.reduceat(_BYTES[data] * odd, start)
        h = mixed(h + n.astype(np.uint64))
    else:
        h = np.zeros(0, np.uint64)
    owner = np.searchsorted(ends, begin, side="right")
    per = np.bincount(owner, minlength=len(texts))
    close = np.cumsum(per + 1) - 1  # index of each text's end token
    key = np.empty(len(h) + len(texts), np.uint64)
    is_word = np.ones(len(key), bool)
    is_word[close] = False
    key[is_word] = h
    key[close] = END_KEY
    before = np.concatenate([[START_KEY], key[:-1]])
    before[np.concatenate([[0], close[:-1] + 1])] = START_KEY
    return key, before, np.repeat(np.arange(len(texts)), per + 1)


def pair(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(key))


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; ascending ones as differences."""
    import zstandard

    x = np.ascontiguousarray(x, "<u8")
    if ascending and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def _ipc(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def _open(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


@dataclass(frozen=True)
class Chunk:
    """The n-grams of a chunk's texts: distinct sorted keys with counts by role, and which key each token has."""

    table: pa.Table
    role: np.ndarray
    owner: np.ndarray
    uni: np.ndarray
    uni_at: np.ndarray
    before_at: np.ndarray
    bi: np.ndarray
    bi_at: np.ndarray

    @staticmethod
    def read(blob: bytes) -> Chunk:
        table = _open(blob)
        texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        got, at = [], 0
        while at < len(texts) or not got:  # a piece at a time: the arrays have several entries for each byte
            end, size = at, 0
            while end < len(texts) and size < PIECE:
                size += len(texts[end])
                end += 1
            key, before, owner = tokens(texts[at:end])
            got.append((key, before, owner + at))
            at = end
        key, before, owner = (np.concatenate(x) for x in zip(*got, strict=True))
        uni, uni_at = np.unique(key, return_inverse=True)
        # the start occurs as often as the end, so the end's count stands for it
        before_at = np.searchsorted(uni, np.where(before == START_KEY, END_KEY, before))
        bi, bi_at = np.unique(pair(before, key), return_inverse=True)
        return Chunk(table, table.column("role").to_numpy(), owner, uni, uni_at, before_at, bi, bi_at)

    def counts(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        role = self.role[self.owner]
        return [np.bincount(at[role == r], minlength=n) for r in (KEPT, DELETED)]


def _store(docs: DataFrame, training: Column, deleted: Column, text: str) -> DataFrame:
    """Chunks: (chunk, bytes, blob) with the other columns of ``docs`` as one struct, the role and the text of each row."""
    import uuid

    role = F.when(training & deleted, DELETED).when(training, KEPT).otherwise(UNSEEN).cast("int")
    rest = [F.col(c) for c in docs.columns if c != text]
    packed = docs.select(F.struct(*rest, F.lit(None).cast("string").alias("_end")).alias("rest"), role.alias("role"), F.col(text).alias("text"))

    def run(batches):
        held, size = {True: [], False: []}, {True: 0, False: 0}

        def out(kind: bool):
            table = pa.Table.from_batches(held[kind]).combine_chunks()
            done = pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([kind]), pa.array([size[kind]]), pa.array([_ipc(table)])], ["chunk", "deleted", "bytes", "blob"])
            held[kind], size[kind] = [], 0
            return done

        for whole in batches:
            for kind in (True, False):  # rows of the deleted part get chunks of their own
                batch = whole.filter(pc.equal(pc.equal(whole.column(1), DELETED), kind))
                lengths = np.array([x or 0 for x in pc.binary_length(batch.column(2)).to_pylist()], np.int64)
                at = 0
                while at < batch.num_rows:
                    upto = min(batch.num_rows, at + 1 + int(np.searchsorted(np.cumsum(lengths[at:]), max(CHUNK - size[kind], 1))))
                    held[kind].append(batch.slice(at, upto - at))
                    size[kind] += int(lengths[at:upto].sum())
                    at = upto
                    if size[kind] >= CHUNK:
                        yield out(kind)
        for kind in (True, False):
            if held[kind]:
                yield out(kind)

    return packed.mapInArrow(run, "chunk string, deleted boolean, bytes long, blob binary")


def _requests(store: DataFrame, ranges: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Chunk.read(blob.as_py())
                for kind, (keys, at) in enumerate(((c.uni, c.uni_at), (c.bi, c.bi_at))):
                    kept, deleted = c.counts(at, len(keys))
                    cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                    rows = [(part, kind, chunk, pack(keys[i:j], True), pack(kept[i:j]), pack(deleted[i:j])) for part, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                    for k in range(0, len(rows), 64):
                        cols = list(zip(*rows[k : k + 64], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *map(pa.array, cols[2:])], ["part", "kind", "chunk", "keys", "kept", "deleted"])

    return store.select("chunk", "blob").mapInArrow(run, "part int, kind int, chunk string, keys binary, kept binary, deleted binary")


REPLY = "chunk string, kind int, part int, kept binary, deleted binary, n_kept long, n_all long, v_kept long, v_all long"


def _answer(table: pa.Table) -> pa.Table:
    """The owner of one key range: totals of each key, for every chunk in the order it asked."""
    keys = [unpack(x.as_py(), True) for x in table.column("keys")]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for name in ("kept", "deleted"):
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, at, np.concatenate([unpack(x.as_py()) for x in table.column(name)]).astype(np.int64))
        totals.append(sums)
    kept, all_ = totals[0], totals[0] + totals[1]
    parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    one = lambda x: [int(x), *[0] * (len(keys) - 1)]
    return pa.table({
        "chunk": table.column("chunk"), "kind": table.column("kind"), "part": table.column("part"),
        "kept": [pack(totals[0][p]) for p in parts], "deleted": [pack(totals[1][p]) for p in parts],
        "n_kept": one(kept.sum()), "n_all": one(all_.sum()), "v_kept": one((kept > 0).sum()), "v_all": one((all_ > 0).sum()),
    })


def _totals(replies: pa.Table) -> dict[tuple[int, str], np.ndarray]:
    """(kind, role) -> totals in the order of the chunk's keys."""
    out = {}
    rows = sorted(zip(replies.column("kind").to_pylist(), replies.column("part").to_pylist(), range(replies.num_rows), strict=True))
    for kind in (0, 1):
        for name in ("kept", "deleted"):
            got = [unpack(replies.column(name)[i].as_py()) for k, _, i in rows if k == kind]
            out[kind, name] = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the binary logarithm of their count."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def _estimates(c: Chunk, uni: np.ndarray, bi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: bigram estimate, unigram estimate, context bucket."""
    context = uni[c.before_at]
    return bi[c.bi_at] / np.maximum(context, 1), uni[c.uni_at] / max(n, 1), bucket(context)


def learn_weights(cells: list[tuple[int, int, float, float]], v: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket, from cells (bucket, tokens, bigram estimate, unigram estimate)."""
    weights = np.full((BUCKETS + 1, 3), 1 / 3)
    if cells:
        b, n, f2, f1 = (np.array(x) for x in zip(*cells, strict=True))
        p = np.stack([f2, f1, np.full(len(f1), 1 / (v + 1))], 1)
        # row BUCKETS: all together, for buckets without deleted tokens
        group = np.concatenate([b.astype(int), np.full(len(b), BUCKETS)])
        n, p = np.tile(n, 2).astype(float), np.tile(p, (2, 1))
        for _ in range(STEPS):
            share = weights[group] * p
            share *= (n / share.sum(1))[:, None]
            sums = np.stack([np.bincount(group, share[:, k], BUCKETS + 1) for k in range(3)], 1)
            total = sums.sum(1, keepdims=True)
            weights = np.where(total > 0, sums / np.maximum(total, 1e-300), weights[BUCKETS])
        weights = np.where(np.bincount(group, n, BUCKETS + 1)[:, None] > 0, weights, weights[BUCKETS])
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0.0  # an unseen context has no estimate
    return weights / weights.sum(1, keepdims=True)


def score_documents(docs: DataFrame, training: Column, deleted: Column, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, then n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score.

    Learns from the rows where ``training`` holds; of these the ones where ``deleted`` holds too are left out of the
    estimates while the weights are learned.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = make_room(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    store = materialise(_store(docs, F.coalesce(training, F.lit(False)), F.coalesce(deleted, F.lit(False)), text))
    size = store.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(12, -(-size // RANGE))
    asked = _requests(store, ranges)
    replies = materialise(asked.groupBy("kind", "part").applyInArrow(_answer, REPLY))
    sums = replies.filter("kind = 0").agg(F.sum("n_kept"), F.sum("n_all"), F.sum("v_kept"), F.sum("v_all")).first()
    n_kept, n_all, v_kept, v_all = (int(x or 0) for x in sums)
    answers = replies.select("chunk", "kind", "part", "kept", "deleted")

    sizes = 2 * (n_kept.bit_length() + 1)  # the smallest estimate is one in n_kept

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        c, t = Chunk.read(left.column("blob")[0].as_py()), _totals(right)
        f2, f1, b = _estimates(c, t[0, "kept"], t[1, "kept"], n_kept)
        size_of = lambda f: np.where(f > 0, np.clip(np.floor(-np.log2(np.maximum(f, 1e-300)) * 2), 0, sizes - 2).astype(np.int64) + 1, 0)
        cell = (b * sizes + size_of(f2)) * sizes + size_of(f1)
        at, inverse = np.unique(cell, return_inverse=True)
        total = lambda w: np.bincount(inverse, w, len(at))
        return pa.table({"cell": at, "n": np.bincount(inverse, minlength=len(at)), "f2": total(f2), "f1": total(f1)})

    part = store.filter("deleted")
    seen = part.select("chunk", "blob").groupBy("chunk").cogroup(answers.join(part.select("chunk"), "chunk", "left_semi").groupBy("chunk")).applyInArrow(cells, "cell long, n long, f2 double, f1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1"))
    rows = sorted(map(tuple, seen.collect()))  # at most BUCKETS * sizes ** 2 cells
    weights = learn_weights([(cell // sizes**2, n, f2 / n, f1 / n) for cell, n, f2, f1 in rows], v_kept)

    rest = StructType([f for f in docs.schema if f.name != text])
    out = StructType().add("rest", StructType([*rest, *StructType().add("_end", StringType())]))
    for name in ("n_tokens", "n_known", "train_tokens"):
        out = out.add(name, LongType())
    out = out.add("base_score", DoubleType()).add("score", DoubleType())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c, t = Chunk.read(left.column("blob")[0].as_py()), _totals(right)
        uni, bi = t[0, "kept"] + t[0, "deleted"], t[1, "kept"] + t[1, "deleted"]
        f2, f1, b = _estimates(c, uni, bi, n_all)
        w = weights[b]
        p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (v_all + 1)
        if not n_all:
            p = np.ones(len(p))
        known = uni[c.uni_at]
        texts = c.table.num_rows
        total = lambda x: np.bincount(c.owner, x, texts)
        cols = [
            c.table.column("rest").combine_chunks(), np.bincount(c.owner, minlength=texts), np.bincount(c.owner, known > 0, texts).astype(np.int64), np.full(texts, n_all),
            total(np.log10((known + 1) / (n_all + v_all + 1))), total(np.log10(p)),
        ]
        schema = to_arrow_schema(out)
        return pa.table([pa.chunked_array([cols[0].cast(schema.field(0).type)]) if not isinstance(cols[0], pa.ChunkedArray) else cols[0].cast(schema.field(0).type), *map(pa.array, cols[1:])], schema=schema)

    done = store.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, out)
    return done.select(*[F.col("rest")[f.name].alias(f.name) for f in rest], *[f.name for f in out[1:]])
