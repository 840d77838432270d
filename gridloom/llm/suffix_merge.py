"""Removal of byte strings that an earlier document also holds, by merging front-coded sorted runs of suffixes.

Every SPAN-byte string of a text that also starts in a document with a smaller id is removed (overlaps count, all
strings are judged on the input). To keep the sort small, suffixes are first sieved without loss:

1. Each SPAN-byte window names the smallest hash among its GRAM-byte strings (its minimiser), a function of its
   content alone. Chunks of documents send the distinct minimisers; one owner per key range tells which occur in two
   or more documents, and which head more than HOT different segments. All other windows are unique and drop out.
2. Neighbouring windows with one minimiser form a segment, the suffix at its first window cut after its last.
   A chunk sorts the segments left, drops repeats, and sends a front-coded run (shared prefix length and the rest)
   to each key range. The owner merges the runs with a loser tree that compares by known common-prefix lengths
   first and otherwise starts behind them, so no byte of a known prefix is compared again.
3. In merged order equal segments meet; segments of one minimiser that differ are compared window by window. Each
   chunk gets back, for every window it asked about, the smallest id that holds it, and removes what a smaller id covers.

   Segments of a HOT minimiser (the edge of a passage that very many documents hold, each in other surroundings) are sent window by
   window, each led by its own hash, so that they spread over all key ranges instead of meeting in one.

Chunks hold about CHUNK bytes; key ranges grow in number with the input. Groups of copies cost an entry per chunk, never pairs.

Defined results: null text is empty; texts shorter than SPAN lose nothing, very long ones are read whole; a null id counts as larger than any
other; equal ids never remove from each other, so repeated rows stay alike and there are no ties; the kept bytes may not be valid text and are
binary; an empty table gives no rows; other input columns travel in a struct, those named like the results give way to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from ._shared import make_room, materialise
from .interpolated_lm import mixed, pack, unpack

SPAN, GRAM = 50, 20
SLOTS = SPAN - GRAM + 1  # GRAM-byte strings of a window
CHUNK, RANGE = 5 << 20, 6 << 20
HOT = 2000
NO_ID = np.iinfo(np.int64).max
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_P = 0x9FB21C651E98DF25 | 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position, by doubling."""
    power = lambda n: np.uint64(pow(_P, n, 1 << 64))
    h, size = {1: _BYTES[data]}, 1
    while 2 * size <= GRAM:
        x = h[size]
        h[2 * size] = x[:-size] * power(size) + x[size:]
        size *= 2
    out, have = h[size], size
    while have < GRAM:
        size = max(s for s in h if s <= GRAM - have)
        n = len(data) - have - size + 1
        out = out[:n] * power(size) + h[size][have : have + n]
        have += size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def smallest(h: np.ndarray) -> np.ndarray:
    """Minimum of each SLOTS neighbours."""
    m, size = h, 1
    while 2 * size <= SLOTS:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = SLOTS - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, then per segment: minimiser, first window, windows, text index)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    keys, firsts, counts, owners = [], [], [], []
    lo = 0
    while lo < len(texts):  # a piece of texts at a time bounds the arrays
        hi = lo + 1
        while hi < len(texts) and ends[hi] - (ends[lo] - sizes[lo]) <= 1 << 18:
            hi += 1
        base = ends[lo] - sizes[lo]
        part = data[base : ends[hi - 1]]
        if len(part) >= SPAN:
            m = smallest(gram_hashes(part))  # one for each window
            new = np.empty(len(m), bool)
            new[0] = True
            np.not_equal(m[1:], m[:-1], out=new[1:])
            stops = ends[lo:hi] - base
            new[stops[stops < len(m)]] = True
            run = np.nonzero(new)[0]
            length = np.diff(np.append(run, len(m)))
            if (length > SLOTS).any():  # repetitive text
                n = -(-length // SLOTS)
                run = np.repeat(run, n) + SLOTS * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                length = np.minimum(SLOTS, np.diff(np.append(run, len(m))))
            own = np.searchsorted(stops, run, side="right")
            length = np.minimum(length, stops[own] - SPAN + 1 - run)  # windows end within their text
            ok = length > 0
            keys.append(m[run[ok]])
            firsts.append(run[ok] + base)
            counts.append(length[ok])
            owners.append(own[ok] + lo)
        lo = hi
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return data, cat(keys, np.uint64), cat(firsts, np.int64), cat(counts, np.int64), cat(owners, np.int64)


class LoserTree:
    """Merges sorted runs of byte strings; what is known of common prefixes with the last output is never compared again.

    A run yields (length of the prefix shared with its own string before, string). The loser of a match keeps the length of
    the prefix it shares with the winner; of two candidates the one that shares more with the last output is the smaller.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        # a player is (prefix shared with the last output, string or None, run)
        players = []
        for i in range(size):
            first = next(self.runs[i], None) if i < len(runs) else None
            players.append((0, first[1] if first else None, i))
        self.losers: list = [None] * size
        level = players
        while len(level) > 1:
            nxt = []
            for k in range(0, len(level), 2):
                win, lose = self.match(level[k], level[k + 1])
                self.losers[len(level) // 2 + k // 2] = lose
                nxt.append(win)
            level = nxt
        self.top = level[0]

    @staticmethod
    def match(a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """(winner, loser): both know what they share with the last output."""
        if a[1] is None:
            return b, a
        if b[1] is None:
            return a, b
        la, lb = a[0], b[0]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        x, y = a[1], b[1]
        if x == y:
            return a, (len(x), y, b[2])
        n = min(len(x), len(y))
        i = la
        while i + 8 <= n and x[i : i + 8] == y[i : i + 8]:
            i += 8
        while i < n and x[i] == y[i]:
            i += 1
        if i == n and len(x) < len(y) or i < n and x[i] < y[i]:
            return a, (i, y, b[2])
        return b, (i, x, a[2])

    def __iter__(self):
        """(prefix shared with the output before, string, run), in order."""
        losers, size, runs, match = self.losers, self.size, self.runs, self.match
        while self.top[1] is not None:
            yield self.top
            run = self.top[2]
            got = next(runs[run], None)
            now = (got[0], got[1], run) if got else (0, None, run)
            k = (size + run) >> 1
            while k:
                other = losers[k]
                if now[1] is not None and (other[1] is None or now[0] > other[0]):
                    pass  # decided by what is known
                elif other[1] is not None and (now[1] is None or other[0] > now[0]):
                    losers[k], now = now, other
                else:
                    now, losers[k] = match(now, other)
                k >>= 1
            self.top = now


def _zip(x: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(x)


def _unzip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths, rests) of sorted strings under 256 bytes."""
    sizes = np.array([len(x) for x in strings], np.int64)
    wide = int(sizes.max(initial=1))
    shared = np.zeros(len(strings), np.int64)
    for at in range(0, len(strings) - 1, 1 << 15):
        part = strings[at : at + (1 << 15) + 1]
        a = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in part), np.uint8).reshape(len(part), wide)
        differ = a[1:] != a[:-1]
        first = np.where(differ.any(1), differ.argmax(1), wide)
        shared[at + 1 : at + len(part)] = np.minimum(first, np.minimum(sizes[at : at + len(part) - 1], sizes[at + 1 : at + len(part)]))
    rest = b"".join([x[n:] for x, n in zip(strings, shared.tolist(), strict=True)])
    return _zip(shared.astype(np.uint8).tobytes()), _zip(sizes.astype(np.uint8).tobytes()), _zip(rest, 3)


def read_run(shared: bytes, sizes: bytes, rest: bytes):
    """Yields (shared prefix length, string) of a front-coded run."""
    rest, at, last = _unzip(rest), 0, b""
    for n, size in zip(_unzip(shared), _unzip(sizes), strict=True):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        yield n, last


def merge_runs(runs: list, ids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run: (smallest id of each segment's first window, whether its windows differ in that, the ids of all windows of those that do)."""
    at: list[list[int]] = [[] for _ in runs]
    strings: list[bytes] = []
    lows: list[int] = []
    ids_of = [x.tolist() for x in ids]
    for shared, text, run in LoserTree(runs):
        i = ids_of[run][len(at[run])]
        if strings and shared == len(text) == len(strings[-1]):
            if i < lows[-1]:
                lows[-1] = i
        else:
            strings.append(text)
            lows.append(i)
        at[run].append(len(strings) - 1)
    odd: dict[int, list[int]] = {}
    lo = 0
    while lo < len(strings):
        hi, key = lo + 1, strings[lo][:8]
        while hi < len(strings) and strings[hi].startswith(key):
            hi += 1
        if hi - lo > 1:  # segments of one minimiser that differ: window by window
            first: dict[bytes, int] = {}
            cut = [[x[o : o + SPAN] for o in range(8, len(x) - SPAN + 1)] for x in strings[lo:hi]]
            for windows, i in zip(cut, lows[lo:hi], strict=True):
                for w in windows:
                    if first.get(w, NO_ID) >= i:
                        first[w] = i
            for k, windows in enumerate(cut, lo):
                got = [first[w] for w in windows]
                lows[k] = got[0]
                if min(got) != max(got):
                    odd[k] = got
        lo = hi
    low = np.array(lows, np.int64)
    out = []
    for places in at:
        p = np.array(places, np.int64)
        differ = np.array([k in odd for k in places], bool)
        out.append((low[p], differ, np.array([i for k in places if k in odd for i in odd[k]], np.int64)))
    return out


class Chunk:
    """Documents of a chunk and their segments."""

    def __init__(self, blob: bytes, doc_id: str):
        self.table = pa.ipc.open_stream(pa.py_buffer(_unzip(blob))).read_all()
        self.texts = [t or b"" for t in self.table.column("text").cast(pa.large_binary()).to_pylist()]
        self.ids = self.table.column("id").fill_null(NO_ID).to_numpy().astype(np.int64)
        self.data, self.keys, self.first, self.count, self.owner = segments(self.texts)
        self.distinct, self.at = np.unique(self.keys, return_inverse=True)

    def in_several(self) -> np.ndarray:
        """Which of the distinct minimisers lie in documents of different ids already here."""
        ids = self.ids[self.owner]
        low, high = np.full(len(self.distinct), NO_ID), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.at, ids)
        np.maximum.at(high, self.at, ids)
        return low != high

    def variety(self) -> np.ndarray:
        """About how many different segments each of the distinct minimisers heads: told apart by length, ends and middle."""
        text = np.append(self.data, np.zeros(2 * SPAN, np.uint8)).astype(np.uint64)
        look = self.count.astype(np.uint64)
        for at in (self.first, self.first + 4, self.first + 9, self.first + self.count + SPAN - 2, self.first + self.count + SPAN - 7, self.first + self.count // 2 + SPAN // 2):
            look = mixed(look * np.uint64(0x9E3779B97F4A7C15) + text[at])
        pair = np.unique(self.at.astype(np.uint64) << np.uint64(32) | look >> np.uint64(32))
        return np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(self.distinct))

    def spread(self, hot: np.ndarray) -> None:
        """Cuts the segments of the minimisers where ``hot`` holds into windows, each with its own hash as key."""
        which = hot[self.at]
        if not which.any():
            return
        n = self.count[which]
        first = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = np.zeros(len(first), np.uint64)
        odd = mixed(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        for k in range(0, len(first), 1 << 14):
            window = self.data[first[k : k + (1 << 14), None] + np.arange(SPAN)]
            keys[k : k + (1 << 14)] = mixed((_BYTES[window] * odd).sum(1, dtype=np.uint64))
        join = lambda x, y: np.concatenate([x[~which], y])
        self.owner, self.keys = join(self.owner, np.repeat(self.owner[which], n)), join(self.keys, keys)
        self.count, self.first = join(self.count, np.ones(len(first), np.int64)), join(self.first, first)

    def shared(self, bits: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(indices, strings led by their minimiser) of the segments whose minimiser several documents hold."""
        some = bits[self.at]
        self.keys, self.first, self.count, self.owner, self.at = (x[some] for x in (self.keys, self.first, self.count, self.owner, self.at))
        self.spread(hot)
        lead = self.keys.astype(">u8").tobytes()
        text = self.data.tobytes()
        return np.arange(len(self.keys)), [lead[8 * k : 8 * k + 8] + text[a : a + n + SPAN - 1] for k, (a, n) in enumerate(zip(self.first.tolist(), self.count.tolist(), strict=True))]


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def _store(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    import uuid

    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(None).cast("string").alias("_end")).alias("rest"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        held, size = [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write(table)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([size]), pa.array([_zip(sink.getvalue(), 6)])], ["chunk", "bytes", "blob"])

        for batch in batches:
            lengths = np.array([x or 0 for x in pc.binary_length(batch.column(2)).to_pylist()], np.int64)
            at = 0
            while at < batch.num_rows:
                upto = min(batch.num_rows, at + 1 + int(np.searchsorted(np.cumsum(lengths[at:]), max(CHUNK - size, 1))))
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return packed.mapInArrow(run, "chunk string, bytes long, blob binary")


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]):
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[k : k + 64], strict=True), types, strict=True)], names)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` but the text, then kept (binary), n_bytes, n_removed and n_spans of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = make_room(docs, "kept", "n_bytes", "n_removed", "n_spans")
    store = materialise(_store(docs, text, doc_id))
    size = store.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(12, -(-size // RANGE))
    blobs = store.select("chunk", "blob")

    def ask(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Chunk(blob.as_py(), doc_id)
                at, flags, variety = cuts(c.distinct, ranges), c.in_several(), c.variety().astype(np.uint64)
                rows = [(p, chunk, pack(c.distinct[i:j], True), _zip(np.packbits(flags[i:j]).tobytes()), pack(variety[i:j])) for p, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if j > i]
                yield from _batches(rows, ["part", "chunk", "keys", "flags", "variety"], [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()])

    def common(table: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py(), True) for x in table.column("keys")]
        flags = [np.unpackbits(np.frombuffer(_unzip(x.as_py()), np.uint8), count=len(k)) for x, k in zip(table.column("flags"), keys, strict=True)]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        several = (np.bincount(at, minlength=len(known)) > 1) | (np.bincount(at, np.concatenate(flags), len(known)) > 0)
        hot = several & (np.bincount(at, np.concatenate([unpack(x.as_py()) for x in table.column("variety")]).astype(np.int64), len(known)) > HOT)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        packed = lambda x: [_zip(np.packbits(y).tobytes()) for y in np.split(x[at], ends)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "n": [len(k) for k in keys], "bits": packed(several), "hot": packed(hot)})

    asked = blobs.mapInArrow(ask, "part int, chunk string, keys binary, flags binary, variety binary")
    bits = materialise(asked.groupBy("part").applyInArrow(common, "chunk string, part int, n long, bits binary, hot binary"))

    def all_bits(table: pa.Table) -> list[np.ndarray]:
        """Of a chunk's distinct minimisers, which several documents hold, and which are hot."""
        rows = sorted(x for x in zip(*(table.column(c).to_pylist() for c in ("part", "n", "bits", "hot")), strict=True) if x[2] is not None)
        got = [[np.unpackbits(np.frombuffer(_unzip(r[k]), np.uint8), count=r[1]) for r in rows] for k in (2, 3)]
        return [np.concatenate(g).astype(bool) if g else np.zeros(0, bool) for g in got]

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("blob")[0].as_py(), doc_id)
        which, strings = c.shared(*all_bits(right))
        low: dict[bytes, int] = {}
        for x, i in zip(strings, c.ids[c.owner[which]].tolist(), strict=True):
            if low.get(x, NO_ID) >= i:
                low[x] = i
        order = sorted(low)
        keys = np.frombuffer(b"".join([x[:8] for x in order]), ">u8").astype(np.uint64)
        at, chunk, rows = cuts(keys, ranges), left.column("chunk")[0].as_py(), []
        for p, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if j > i:
                part = order[i:j]
                rows.append((p, chunk, *front_code(part), pack(np.array([low[x] for x in part], np.int64).view(np.uint64))))
        names, types = ["part", "chunk", "shared", "sizes", "rest", "ids"], [pa.int32(), pa.string(), *[pa.binary()] * 4]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    def merge(table: pa.Table) -> pa.Table:
        col = lambda n: table.column(n).to_pylist()
        ids = [unpack(x).view(np.int64) for x in col("ids")]
        found = merge_runs([read_run(*x) for x in zip(col("shared"), col("sizes"), col("rest"), strict=True)], ids)
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column("part"), "n": [len(x) for x, _, _ in found],
            "low": [pack(x.view(np.uint64)) for x, _, _ in found], "differ": [_zip(np.packbits(x).tobytes()) for _, x, _ in found], "each": [pack(x.view(np.uint64)) for _, _, x in found],
        })

    sent = blobs.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(runs, "part int, chunk string, shared binary, sizes binary, rest binary, ids binary")
    answers = sent.groupBy("part").applyInArrow(merge, "chunk string, part int, n long, low binary, differ binary, each binary")
    # one table for the last step: the bits again, and the answers
    empty = F.lit(None).cast("binary")
    both = bits.select("chunk", "part", "n", "bits", "hot", *[empty.alias(x) for x in ("low", "differ", "each")]).unionByName(answers.withColumn("bits", empty).withColumn("hot", empty))

    rest = StructType([f for f in docs.schema if f.name != text])
    out = StructType().add("rest", StructType([*rest, *StructType().add("_end", StringType())])).add("kept", BinaryType())
    for name in ("n_bytes", "n_removed", "n_spans"):
        out = out.add(name, LongType())

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("blob")[0].as_py(), doc_id)
        which, strings = c.shared(*all_bits(right.filter(pc.is_valid(right.column("bits")))))
        edge = np.zeros(len(c.data) + 1, np.int64)
        if len(which):
            rows = right.filter(pc.is_valid(right.column("low")))
            rows = sorted(zip(*(rows.column(n).to_pylist() for n in ("part", "n", "low", "differ", "each")), strict=True))
            low = np.concatenate([unpack(r[2]).view(np.int64) for r in rows])
            differ = np.concatenate([np.unpackbits(np.frombuffer(_unzip(r[3]), np.uint8), count=r[1]) for r in rows]).astype(bool)
            each = np.concatenate([unpack(r[4]).view(np.int64) for r in rows])
            order = {x: k for k, x in enumerate(sorted(set(strings)))}
            at = np.array([order[x] for x in strings], np.int64)
            sizes = np.zeros(len(order), np.int64)
            sizes[at] = c.count[which]
            where = np.cumsum(np.where(differ, sizes, 0)) - np.where(differ, sizes, 0)
            first, n, ids = c.first[which], c.count[which], c.ids[c.owner[which]]
            gone = ~differ[at] & (low[at] < ids)
            np.add.at(edge, first[gone], 1)
            np.add.at(edge, first[gone] + n[gone] + SPAN - 1, -1)
            some = np.nonzero(differ[at])[0]
            n = n[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = each[np.repeat(where[at[some]], n) + within] < np.repeat(ids[some], n)
            window = (np.repeat(first[some], n) + within)[gone]
            np.add.at(edge, window, 1)
            np.add.at(edge, window + SPAN, -1)
        mask = np.cumsum(edge[:-1]) > 0
        kept, removed, spans, at = [], [], [], 0
        for t in c.texts:
            m = mask[at : at + len(t)]
            gone = int(m.sum())
            kept.append(c.data[at : at + len(t)][~m].tobytes() if gone else t)
            removed.append(gone)
            spans.append(int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if gone else 0)
            at += len(t)
        schema = to_arrow_schema(out)
        lead = c.table.column("rest").combine_chunks()
        return pa.table([lead.cast(schema.field(0).type), pa.array(kept, pa.binary()), pa.array([len(t) for t in c.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], schema=schema)

    done = blobs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, out)
    return done.select(*[F.col("rest")[f.name].alias(f.name) for f in rest], "kept", "n_bytes", "n_removed", "n_spans")
