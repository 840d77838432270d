"""Benchmark decontamination by latent semantic retrieval.

1. Documents are tokenised once: the places of the words that the benchmark has are written to the checkpoint folder, packed by
   chunks of documents. All later passes read these hits, not the texts.
2. Passages (WINDOW words, half overlapping) are TF-IDF vectors over the benchmark's words; weights come from all passages of the corpus,
   and no word has weight zero, however common.
3. The latent space is a truncated SVD of the TF-IDF passages. The span of the benchmark's own passages is kept whole (a plain SVD of
   a small matrix), as a space without it loses paraphrases. The corpus passages, deflated by that span, get a distributed randomised
   SVD: tasks multiply their passages with EXTRA + OVERSAMPLE random directions and back, sums over all tasks have a fixed
   size, and the driver takes the EXTRA leading singular vectors of the sketch (Nystroem form, so one pass is enough).
4. Each corpus passage is projected and its cosine with each benchmark passage taken. Candidates are pairs whose cosine is that of a
   passage that holds a share COVER of the benchmark passage, or more: COVER * |q| / |z| for latent lengths |q| and |z|.
5. The longest common subsequence of words around a candidate decides (the item's length to both sides): a share of the item of FULL or
   more is a leak, a share of PART or more is one if the words of the item's answer are there in order too (a paraphrase). The
   answer is what follows the last "answer:", else the last ANSWER words.

The benchmark is a query set that goes to all tasks; it is cut into portions of up to BLOCK items and RANK passages, each with
a space of its own; TOGETHER portions share a pass over the hits, so what a task holds is bounded.

Defined results: null and blank texts leak nothing; very long texts are searched whole; a blank item is in no document; repeated rows are
judged one by one, equal items each count; of tied regions the largest share is given; an item shorter than MIN_ITEM words only counts when
it is there whole; an empty benchmark or an empty table gives no rows; input columns named item_id or share give way to the operator's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._shared import make_room, materialise
from .interpolated_lm import END_KEY, tokens

WINDOW, STRIDE = 64, 32
RANK, EXTRA, OVERSAMPLE, BLOCK, TOGETHER = 384, 32, 8, 256, 4
COVER = 0.3  # share of a benchmark passage's vector
FULL, PART, ANSWER, MIN_ITEM = 0.75, 0.55, 5, 8
CHUNK, PIECE, SEED = 4 << 20, 1 << 18, 7
SLOT_BITS, SHARED = 18, -2
SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
#: Terms that most passages have: their counts are multiplied as a matrix, all other terms are added up one by one.
DENSE = 64
#: Words of an item whose common subsequences are found for many candidates at once, in the bits of a word.
BITS = 64
#: ASCII punctuation becomes space.
PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def pieces(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word keys, text index from the first) of runs of texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < PIECE:
            size += len(texts[end] or b"")
            end += 1
        key, _, owner = tokens([(t or b"").translate(PLAIN) for t in texts[at:end]])
        yield at, key, owner
        at = end


def runs(x: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """The benchmark's words by key, with a table to look many keys up."""

    keys: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Vocabulary:
        keys = np.unique(keys)
        slots = np.full(1 << SLOT_BITS, -1, np.int32)
        slot, n = np.unique(keys >> SLOT_SHIFT, return_counts=True)
        slots[keys >> SLOT_SHIFT] = np.arange(len(keys))
        slots[slot[n > 1]] = SHARED
        return Vocabulary(keys, slots)

    def terms(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for keys that the benchmark lacks."""
        at = self.slots[key >> SLOT_SHIFT].astype(np.int64)
        crowded = np.flatnonzero(at == SHARED)
        at[crowded] = np.minimum(np.searchsorted(self.keys, key[crowded]), len(self.keys) - 1)
        at[(at >= 0) & (self.keys[at] != key)] = -1
        return at


def benchmark_words(texts: list[str | None]) -> tuple[Vocabulary, list[np.ndarray], list[list[int]]]:
    """(vocabulary, terms of each item, terms of each item's answer)."""
    raw = [(t or "").encode() for t in texts]
    split = lambda ts: [k[:-1] for k in np.split(*(lambda k, o: (k, runs(o)[1:]))(*tokens([t.translate(PLAIN) for t in ts])[::2]))] if ts else []
    words = split(raw)
    tails = split([re.split(rb"(?i)answer:", t)[-1] if re.search(rb"(?i)answer:", t) else b"" for t in raw])
    vocabulary = Vocabulary.of(np.concatenate([*words, np.zeros(0, np.uint64)]))
    items = [np.searchsorted(vocabulary.keys, w) for w in words]
    answers = [np.searchsorted(vocabulary.keys, a) if len(a) else w[-ANSWER:] for a, w in zip(tails, items, strict=True)]
    return vocabulary, items, [a.tolist() for a in answers]


@dataclass(frozen=True)
class Portion:
    """Items that share a latent space. Terms are indices into ``own``, the portion's part of the vocabulary."""

    ids: list
    items: list[np.ndarray]
    answers: list[list[int]]
    own: np.ndarray
    passages: list[np.ndarray]
    passage_item: np.ndarray

    @staticmethod
    def of(ids: list, items: list[np.ndarray], answers: list[list[int]]) -> Portion:
        own = np.unique(np.concatenate([*items, np.zeros(0, np.int64)]))
        local = [np.searchsorted(own, w) for w in items]
        passages = [(i, p) for i, w in enumerate(local) for p in cut(w)]
        return Portion(ids, local, [np.searchsorted(own, a).tolist() for a in answers], own, [p for _, p in passages], np.array([i for i, _ in passages], np.int64))


def cut(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages."""
    last = max(len(words) - WINDOW, 0)
    return [words[min(at, last) :][:WINDOW] for at in range(0, last + STRIDE, STRIDE)] if len(words) else []


def portions(ids: list, items: list[np.ndarray], answers: list[list[int]]) -> Iterator[Portion]:
    at = 0
    while at < len(ids):
        end, n = at, 0
        while end < min(len(ids), at + BLOCK) and (end == at or n + len(cut(items[end])) <= RANK):
            n += len(cut(items[end]))
            end += 1
        yield Portion.of(ids[at:end], items[at:end], answers[at:end])
        at = end


def _planes(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _whole(b: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


STORE = "rest binary, words binary, hits binary, gaps binary, terms binary"


def _store(docs: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """Chunks of documents: other columns, words of each document, hits of each, and place (as a gap) and term of each hit."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(None).cast("string").alias("_end")).alias("rest"), F.col(text).alias("text"))

    def chunk(table: pa.Table) -> pa.RecordBatch | None:
        texts = table.column(1).cast(pa.large_binary()).to_pylist()
        words, counts, places, terms = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], []
        for base, key, owner in pieces(texts):
            start = runs(owner)
            hit = np.flatnonzero((term := vocabulary.terms(key)) >= 0)
            words[base + owner[start]] = np.diff(np.append(start, len(owner)))
            counts[base : base + owner[-1] + 1] += np.bincount(owner[hit], minlength=owner[-1] + 1)
            places.append(hit - np.repeat(start, np.diff(np.append(start, len(owner))))[hit])
            terms.append(term[hit])
        place = np.concatenate([*places, np.zeros(0, np.int64)])
        if not len(place):
            return None
        gaps = np.diff(place, prepend=0)
        first = (np.cumsum(counts) - counts)[counts > 0]
        gaps[first] = place[first]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select([0]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write(table.select([0]))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), _planes(words), _planes(counts), _planes(gaps), _planes(np.concatenate(terms)))], ["rest", "words", "hits", "gaps", "terms"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            sizes = np.array([x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()], np.int64)
            at = 0
            while at < batch.num_rows:
                upto = min(batch.num_rows, at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), max(CHUNK - size, 1))))
                held.append(batch.slice(at, upto - at))
                size += int(sizes[at:upto].sum())
                at = upto
                if size >= CHUNK:
                    if (done := chunk(pa.Table.from_batches(held))) is not None:
                        yield done
                    held, size = [], 0
        if held and (done := chunk(pa.Table.from_batches(held))) is not None:
            yield done

    return packed.mapInArrow(run, STORE)


class Hits:
    """The hits of a chunk. ``place`` counts words over the whole chunk; blocks of STRIDE words never reach over a document's end."""

    def __init__(self, words: bytes, hits: bytes, gaps: bytes, terms: bytes):
        self.words, counts, self.term = _whole(words), _whole(hits), _whole(terms)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.base = np.cumsum(self.words) - self.words
        within = np.cumsum(_whole(gaps))
        first = np.cumsum(counts) - counts
        before = np.where(first > 0, within[np.maximum(first - 1, 0)], 0)
        within -= before[self.doc]
        self.place = self.base[self.doc] + within
        of_doc = -(-self.words // STRIDE)
        self.blocks = int(of_doc.sum())
        self.first_block = np.cumsum(of_doc) - of_doc
        self.block = self.first_block[self.doc] + within // STRIDE


def add_up(sums: DataFrame, shapes: list[tuple]) -> list[np.ndarray]:
    """Adds up rows of float64 arrays (binary columns a0, a1, ...) of fixed shapes: in tasks, fewer at each step, then here."""
    names = [f"a{k}" for k in range(len(shapes))]

    def add(batches):
        total = [np.zeros(s) for s in shapes]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                for x in column:
                    total[k] += np.frombuffer(x.as_py()).reshape(shapes[k])
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], names)

    schema = ", ".join(f"{n} binary" for n in names)
    out = [np.zeros(s) for s in shapes]
    n = sums.rdd.getNumPartitions()
    while n > 64:
        n = max(8, int(n**0.5))
        sums = sums.repartition(n).mapInArrow(add, schema)
    for row in sums.repartition(8).mapInArrow(add, schema).collect():  # 8 rows of fixed size
        for k, x in enumerate(row):
            out[k] += np.frombuffer(x).reshape(shapes[k])
    return out


def block_counts(store: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(blocks with each term, blocks) of the corpus."""

    def run(batches):
        df, total = np.zeros(n), 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h = Hits(*row)
                pair = np.unique(h.block * n + h.term)
                df += np.bincount(pair % n, minlength=n)
                total += h.blocks
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([np.array([total], float).tobytes()])], ["a0", "a1"])

    df, total = add_up(store.select("words", "hits", "gaps", "terms").mapInArrow(run, "a0 binary, a1 binary"), [(n,), (1,)])
    return df, int(total[0])


class Table:
    """Rows of numbers for the terms of a portion; adds up the rows of the terms of each block."""

    def __init__(self, portion: Portion, rows: np.ndarray, df: np.ndarray, vocabulary: int):
        self.rows = np.ascontiguousarray(rows, np.float32)
        self.local = np.full(vocabulary, -1, np.int32)
        self.local[portion.own] = np.arange(len(portion.own))
        self.common = np.argsort(-df[portion.own], kind="stable")[:DENSE]
        self.dense = np.full(len(portion.own), -1, np.int32)
        self.dense[self.common] = np.arange(len(self.common))

    def sums(self, h: Hits, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(blocks that have a term among the hits lo..hi, their sums, term and index of the block of each such hit)."""
        term = self.local[h.term[lo:hi]]
        here = np.flatnonzero(term >= 0)
        term, block = term[here], h.block[lo:hi][here]
        start = runs(block)
        some, row = block[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(block))))
        place = self.dense[term]
        often = place >= 0
        counts = np.bincount(row[often] * len(self.common) + place[often], minlength=len(some) * len(self.common)).reshape(len(some), -1)
        out = counts.astype(np.float32) @ self.rows[self.common]
        rare, at = term[~often], row[~often]
        if len(rare):
            start = runs(at)
            out[at[start]] += np.add.reduceat(self.rows[rare], start, axis=0)
        return some, out, term, row


def _follows(h: Hits, some: np.ndarray) -> np.ndarray:
    """Whether the next of ``some`` is the next block of the same document."""
    doc = np.searchsorted(h.first_block, some, side="right") - 1
    return np.append((some[1:] == some[:-1] + 1) & (doc[1:] == doc[:-1]), False)


def _slabs(h: Hits) -> Iterator[tuple[int, int]]:
    """Runs of hits of whole documents, so that arrays over a run stay small."""
    first = runs(h.doc)
    ends = np.append(first[1:], len(h.doc))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, (first[lo]) + (1 << 17), side="right")))
        yield int(first[lo]), int(ends[hi - 1])
        lo = hi


def corpus_sketches(store: DataFrame, tables: list[Table]) -> list[np.ndarray]:
    """For each table of random directions: the sum over all passages x of x (x . directions), by term."""
    shapes = [t.rows.shape for t in tables]

    def run(batches):
        total = [np.zeros(s) for s in shapes]
        for batch in batches:
            for row_ in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h = Hits(*row_)
                for lo, hi in _slabs(h):
                    for k, t in enumerate(tables):
                        some, s, term, row = t.sums(h, lo, hi)
                        if not len(some):
                            continue
                        joined = _follows(h, some)
                        whole = s.copy()
                        whole[joined] += s[1:][joined[:-1]]
                        back = whole.copy()  # a block lies in its own passage and in the one that starts a block earlier
                        back[1:][joined[:-1]] += whole[joined]
                        small = term.astype(np.uint16) if shapes[k][0] <= 1 << 16 else term
                        by = np.argsort(small, kind="stable")
                        start = runs(term[by])
                        total[k][term[by][start]] += np.add.reduceat(back[row[by]], start, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], [f"a{k}" for k in range(len(total))])

    schema = ", ".join(f"a{k} binary" for k in range(len(tables)))
    return add_up(store.select("words", "hits", "gaps", "terms").mapInArrow(run, schema), shapes)


def own_span(portion: Portion, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal basis of the TF-IDF vectors of the benchmark's passages, these vectors)."""
    vectors = np.zeros((len(portion.own), len(portion.passages)))
    for k, p in enumerate(portion.passages):
        np.add.at(vectors[:, k], p, idf[p])
    q, size, _ = np.linalg.svd(vectors, full_matrices=False)
    return q[:, size > 1e-9 * size.max(initial=0)], vectors


def directions(span: np.ndarray) -> np.ndarray:
    """Random orthonormal directions outside ``span``."""
    n, m = span.shape
    omega = np.random.default_rng(SEED).standard_normal((n, min(EXTRA + OVERSAMPLE, n - m)))
    for _ in range(2):  # twice, for the sake of rounding
        omega -= span @ (span.T @ omega)
    return np.linalg.qr(omega)[0]


def leading(image: np.ndarray, omega: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The leading singular vectors of the deflated passages, from the image of ``omega`` under their Gram matrix."""
    image = image - span @ (span.T @ image)
    core = omega.T @ image
    w, e = np.linalg.eigh((core + core.T) / 2)
    ok = w > 1e-9 * max(w.max(initial=0), 1e-300)
    u, size, _ = np.linalg.svd(image @ (e[:, ok] / np.sqrt(w[ok])), full_matrices=False)
    u = u[:, size > 1e-6 * size.max(initial=0)][:, :EXTRA]
    return np.linalg.qr(u - span @ (span.T @ u))[0] if u.shape[1] else u


def common_words(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bits of the item's positions."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def is_leak(item: list[int], answer: list[int], text: list[int]) -> tuple[bool, float]:
    share = common_words(item, text) / max(len(item), 1)
    if len(item) < MIN_ITEM:
        return share == 1.0 and len(item) > 0, share
    return share >= FULL or share >= PART and common_words(answer, text) == len(answer), share


class Judge:
    """Decides candidates of a portion, many at once where an item has BITS words or fewer."""

    def __init__(self, portion: Portion):
        self.portion = portion
        self.sizes = np.array([len(w) for w in portion.items], np.int64)
        self.places = np.zeros((len(portion.items), len(portion.own) + 1), np.uint64)
        for i, w in enumerate(portion.items):
            if len(w) <= BITS:
                np.bitwise_or.at(self.places[i], w, np.uint64(1) << np.arange(len(w), dtype=np.uint64))

    def shares(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Longest common subsequences of items with the runs lo..hi of ``term`` (-1 for other words), as shares of the items."""
        out = np.zeros(len(item))
        order = np.argsort(hi - lo, kind="stable")
        order = order[(self.sizes[item[order]] <= BITS) & (self.sizes[item[order]] > 0)]
        for at in range(0, len(order), 1 << 14):
            pick = order[at : at + (1 << 14)]
            which, begin, end = item[pick], lo[pick], hi[pick]
            n = self.sizes[which].astype(np.uint64)
            full = np.where(n == 64, np.uint64(2**64 - 1), (np.uint64(1) << (n % np.uint64(64))) - np.uint64(1))
            v = full.copy()
            for t in range(int((end - begin).max(initial=0))):
                here = begin + t
                u = v & self.places[which, np.where(here < end, term[np.minimum(here, len(term) - 1)], -1)]
                v = ((v + u) | (v - u)) & full
            out[pick] = (n - np.bitwise_count(v)) / np.maximum(n, 1)
        for k in np.flatnonzero(self.sizes[item] > BITS):
            words = self.portion.items[item[k]].tolist()
            out[k] = common_words(words, term[lo[k] : hi[k]].tolist()) / len(words)
        return out

    def leaks(self, doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, term: np.ndarray) -> dict[tuple[int, int], float]:
        """(document, item) -> largest share of the candidates that are leaks."""
        share = self.shares(item, lo, hi, term)
        short = self.sizes[item] < MIN_ITEM
        sure = np.where(short, share == 1, share >= FULL)
        out: dict[tuple[int, int], float] = {}
        for k in np.flatnonzero(sure | ~short & (share >= PART)).tolist():
            answer = self.portion.answers[item[k]]
            if sure[k] or common_words(answer, term[lo[k] : hi[k]].tolist()) == len(answer):
                at = int(doc[k]), int(item[k])
                out[at] = max(out.get(at, 0.0), float(share[k]))
        return out


@dataclass(frozen=True)
class Search:
    """What a task needs to find a portion's candidates."""

    table: Table
    queries: np.ndarray  # unit vectors, one column for each benchmark passage
    least: np.ndarray  # latent length of a share COVER of each benchmark passage
    item: np.ndarray
    judge: Judge

    def leaks(self, h: Hits) -> dict[tuple[int, int], float]:
        found: dict[tuple[int, int], float] = {}
        own = self.table.local[h.term]
        for lo, hi in _slabs(h):
            some, s, _, _ = self.table.sums(h, lo, hi)
            joined = _follows(h, some)
            z = s.copy()
            z[joined] += s[1:][joined[:-1]]
            size = np.sqrt((z * z).sum(1))
            size[size == 0] = 1
            for a in range(0, len(some), 4096):
                long = size[a : a + 4096, None]
                cosine = (z[a : a + 4096] / long) @ self.queries
                w, q = np.nonzero(cosine * long >= self.least)  # cosine >= COVER * |q| / |z|
                if not len(w):
                    continue
                pair = np.unique((w + a) * len(self.judge.sizes) + self.item[q])
                w, i = pair // len(self.judge.sizes), pair % len(self.judge.sizes)
                doc = np.searchsorted(h.first_block, some[w], side="right") - 1
                first = h.base[doc] + (some[w] - h.first_block[doc]) * STRIDE
                n = self.judge.sizes[i]
                begin = np.searchsorted(h.place, np.maximum(h.base[doc], first - n))
                end = np.searchsorted(h.place, np.minimum(h.base[doc] + h.words[doc], first + WINDOW + n))
                for at, share in self.judge.leaks(doc, i, begin, end, own).items():
                    found[at] = max(found.get(at, 0.0), share)
        return found


def searches(store: DataFrame, group: list[Portion], df: np.ndarray, total: int) -> list[Search]:
    """The latent spaces of some portions, from one pass over the hits."""
    idfs = [np.log((total + 1) / (df[p.own] + 1)) + 1 for p in group]  # one or more: words in every passage count too
    spans = [own_span(p, idf) for p, idf in zip(group, idfs, strict=True)]
    omegas = [directions(span) for span, _ in spans]
    images = corpus_sketches(store, [Table(p, idf[:, None] * o, df, len(df)) for p, idf, o in zip(group, idfs, omegas, strict=True)])
    out = []
    for p, idf, (span, vectors), omega, image in zip(group, idfs, spans, omegas, images, strict=True):
        basis = np.hstack([span, leading(idf[:, None] * image, omega, span)])
        queries = basis.T @ vectors
        size = np.linalg.norm(queries, axis=0)
        out.append(Search(Table(p, idf[:, None] * basis, df, len(df)), (queries / np.maximum(size, 1e-12)).astype(np.float32), (COVER * size * (1 - 1e-4)).astype(np.float32), p.passage_item, Judge(p)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(columns of ``docs`` but the text, item_id, share): one row for each document and item that leaked into it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StructType

    docs = make_room(docs, "item_id", "share")
    out = StructType([f for f in docs.schema if f.name != text]).add("item_id", LongType()).add("share", DoubleType())
    schema = to_arrow_schema(out)
    found = docs.sparkSession.createDataFrame([], out)
    order = sorted(((r[0], r[1]) for r in benchmark.select(F.col(item_id).cast("long"), item_text).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    vocabulary, items, answers = benchmark_words([t for _, t in order])
    if not len(vocabulary.keys):
        return found
    store = materialise(_store(docs, text, vocabulary))
    df, total = block_counts(store, len(vocabulary.keys))
    groups = [p for p in portions([i for i, _ in order], items, answers) if len(p.own)]

    def search(parts: list[Search], ids: list[list]):
        def run(batches):
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    h = Hits(*row[1:])
                    hits = sorted((doc, ids[k][i], share) for k, p in enumerate(parts) for (doc, i), share in p.leaks(h).items())
                    if hits:
                        rest = pa.ipc.open_stream(row[0]).read_all().combine_chunks().column(0).combine_chunks()
                        rest = rest.take(pa.array([x[0] for x in hits], pa.int64()))
                        others = [pc.struct_field(rest, [k]).cast(schema.field(k).type) for k in range(len(schema) - 2)]
                        yield pa.RecordBatch.from_arrays([*others, pa.array([x[1] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.float64())], schema=schema)

        return run

    for at in range(0, len(groups), TOGETHER):
        some = groups[at : at + TOGETHER]
        found = found.unionByName(store.mapInArrow(search(searches(store, some, df, total), [p.ids for p in some]), out))
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaked. Judged by text, known by two 64-bit hashes: equal texts leak alike."""
    keys = [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]
    leaks = materialise(find_leaks(docs.select(keys[0].alias("gone0"), keys[1].alias("gone1"), F.col(text).alias("text")), benchmark).select("gone0", "gone1").distinct())
    return docs.join(leaks, (keys[0] == F.col("gone0")) & (keys[1] == F.col("gone1")), "left_anti")
