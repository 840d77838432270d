"""Language identification with a bit-sliced Bloom filter of n-grams.

One table row per hash position holds a bit for each language; a look-up ANDs the rows of an n-gram's
positions and so gets the set of all languages that contain it at once. A text's n-grams are counted per
language (popcounts of the bit columns), each count is corrected for the filter's false positives
of that language, and the language with the largest corrected count wins.

A language contains an n-gram if the n-gram makes up at least MIN_SHARE of the language's n-grams of that
length; hence at most ``1 / MIN_SHARE`` n-grams a length and
language, whatever the corpus: that bounds what the driver and the filter hold. The filter is fitted on
about ``sample`` labelled texts per language, picked by a hash of their id (a documented bound); prediction
reads whole texts of all rows.

Defined results: ``und`` with score 0 for null, empty texts and texts without a letter; without any learned
language also ``und``; ties go to the language first in order; each row is judged by itself, so repeated rows get equal results; very long texts
are read whole; an empty table gives no rows; input columns named lang_pred or score give way to the operator's. More than MOST_LANGUAGES
languages are refused, as the table of their sizes goes to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import make_room, materialise

ORDERS = (1, 2, 3, 4)
MIN_SHARE = 5e-5
HASHES, BITS_A_GRAM = 3, 16
SAMPLE, MOST_LANGUAGES = 3000, 10_000
UNDETERMINED = "und"
SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def squeezed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, lower case, a space for each run of other characters, text index of each)."""
    data = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    codes = np.concatenate([np.array([SPACE], np.uint32), *[x for d in data for x in (d, np.array([SPACE], np.uint32))]])
    owner = np.concatenate([[0], np.repeat(np.arange(len(data), dtype=np.int32), [len(d) + 1 for d in data])]).astype(np.int32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(SPACE))
    keep = np.concatenate([[True], is_letter[1:] | is_letter[:-1]])
    return codes[keep], owner[keep]


def grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the n-grams with a letter. Grams that reach over a text's end are left out: a text's codes end with a space."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    own = owner[order - 1 :]
    ok = owner[:n] == own if order > 1 else codes != SPACE
    if order == 2:
        ok = ok & ((codes[:n] != SPACE) | (codes[1:] != SPACE))
    return h[ok], own[ok]


def pieces(texts: list[str], most: int = 1 << 18):
    """Runs of ``texts`` of about ``most`` characters; arrays over a run stay small."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < most:
            size += len(texts[end]) + 1
            end += 1
        yield texts[at:end]
        at = end


@dataclass(frozen=True)
class LanguageFilter:
    """Rows of bit masks (one 64-bit word for each 64 languages) and the false-positive rate of each language."""

    languages: tuple[str, ...]
    rows: np.ndarray
    wrong: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = self.rows[positions(h, len(self.rows), 0)]
        for k in range(1, HASHES):
            out = out & self.rows[positions(h, len(self.rows), k)]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts by text and language, n-grams of each text)."""
        codes, owner = squeezed(texts)
        total = np.zeros(len(texts))
        seen = np.zeros((len(texts), len(self.languages)))
        for order in ORDERS:
            h, own = grams(codes, owner, order)
            if not len(h):
                continue
            total += np.bincount(own, minlength=len(texts))
            m = self.masks(h)
            for i in range(len(self.languages)):
                bit = (m[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                seen[:, i] += np.bincount(own, weights=bit, minlength=len(texts))
        return np.maximum(seen - total[:, None] * self.wrong, 0) / (1 - self.wrong), total


def positions(h: np.ndarray, n: int, k: int) -> np.ndarray:
    x = h * np.uint64((2 * k + 3) * 0xD6E8FEB86659FD93 % 2**64)
    return (x >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def build(found: list[tuple[str, int]]) -> LanguageFilter:
    """The filter of (language, n-gram hash) pairs."""
    names = tuple(sorted({x for x, _ in found}))
    by = {x: np.array([g for y, g in found if y == x], np.int64).view(np.uint64) for x in names}
    n = 1 << max(10, (BITS_A_GRAM * max([1, *map(len, by.values())]) - 1).bit_length())
    rows = np.zeros((n, max(1, -(-len(names) // 64))), np.uint64)
    wrong = np.zeros(len(names))
    for i, x in enumerate(names):
        bit = np.zeros(n, bool)
        for k in range(HASHES):
            bit[positions(by[x], n, k)] = True
        rows[bit, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        wrong[i] = min(bit.mean() ** HASHES, 0.99)
    return LanguageFilter(names, rows, wrong)


def learn(labelled: DataFrame, by: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageFilter:
    """The filter learned from the rows of ``labelled`` with a text and a language; ``by`` picks the sample."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(by), F.lit(1 << 20)).alias("pick"))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = labelled.sparkSession.createDataFrame([(r[0], r[1]) for r in sizes], "lang string, count long")
    chosen = known.join(F.broadcast(sizes), "lang").filter(F.col("pick") * F.col("count") < sample * (1 << 20)).select("lang", "text")

    def count(batches):
        for batch in batches:
            table: dict[str, list[str]] = {}
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.setdefault(x, []).append(t)
            for x, texts in table.items():
                found: dict[int, list] = {order: [] for order in ORDERS}
                for piece in pieces(texts):
                    codes, owner = squeezed(piece)
                    for order in ORDERS:
                        found[order].append(np.unique(grams(codes, owner, order)[0], return_counts=True))
                for order in ORDERS:
                    h, at = np.unique(np.concatenate([h for h, _ in found[order]]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([c for _, c in found[order]]), len(h))
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(h), pa.string()), pa.array([order] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "size", "gram", "n"])

    counted = materialise(chosen.mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))  # a row for each language and length
    rows = counted.join(F.broadcast(totals), ["lang", "size"]).filter(F.col("n") >= MIN_SHARE * F.col("total")).select("lang", "gram").collect()
    return build([(r[0], r[1]) for r in rows])


def predict_documents(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, then ``lang_pred`` and ``score`` (share of the winner in all languages' counts)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = make_room(docs, "lang_pred", "score")
    out = StructType([f for f in docs.schema if f.name != text]).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches):
        schema = to_arrow_schema(out)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != text]
            at = 0
            for part in pieces(texts):
                end = at + len(part)
                if model.languages:
                    counts, total = model.counts(part)
                    best, all_of = counts.argmax(1), counts.sum(1)
                    names = [model.languages[i] if any(map(str.isalpha, t)) else UNDETERMINED for i, t in zip(best, part, strict=True)]
                    scores = np.where(all_of > 0, counts[np.arange(len(part)), best] / np.maximum(all_of, 1e-9), 0.0)
                else:
                    names, scores = [UNDETERMINED] * len(part), np.zeros(len(part))
                scores = [0.0 if n == UNDETERMINED else float(s) for n, s in zip(names, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at).cast(schema.field(k).type) for k, c in enumerate(rest)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)
                at = end

    return docs.mapInArrow(run, out)
