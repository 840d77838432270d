"""Near-duplicate documents by SimHash, linked with the help of a covering code.

A fingerprint is cut into three blocks. The binary Golay code covers a block's 23-bit space with radius 3,
its words are the anchors: each block has one home anchor within the covering radius, and goes as a replica to every
anchor within the radius plus the block's share of the threshold. Two fingerprints within the threshold
differ by no more than a third of it in some block, so there one's home anchor holds a replica of the other, and comparing homes
with replicas anchor by anchor finds every link. Beyond SINGLE_MOST fingerprints two blocks at a time make the
anchor (the product code), which keeps buckets small; both forms find all links.

Equal fingerprints are collapsed first. Anchors with very many homes are split: homes are dealt to parts, replicas
go to every part. A task writes a spanning forest of the links it finds, never all pairs.

Defined results: null and blank texts have fingerprint zero and link like any other; very long texts are read whole; equal ids count as
one document for ``component_id``, which ignores null ids, and as different documents where rows are dropped, if their texts differ; repeated
rows stay once; a tie between rows of one id goes to the smaller text hash; an empty table gives no rows; input columns may have any
name, those named fp or component_id give way to the operator's.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuzzy_lines as fl
from ._arrow import per_text
from ._graph import components
from ._shared import let, make_room, materialise, partitions_for, words

SHINGLE, SEED, THRESHOLD, SIMILAR_WORDS = 4, 42, 4, 5
BLOCKS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GOLAY, LENGTH, CHECKS, RADIUS = 0xC75, 23, 11, 3  # generator polynomial and parameters of the perfect Golay code
SINGLE_MOST, PART_HOMES = 4_000_000, 4096


def fingerprint(text: bytes | None) -> int:
    import xxhash

    w = (text or b"").lower().split()  # A-Z; white space is that of the word definition
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(len(x) + 1 for x in w))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, then the fingerprint as the signed 64-bit ``fp``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    docs = make_room(docs, "fp")
    out = StructType([f for f in docs.schema if f.name != text]).add("fp", LongType())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return docs.mapInArrow(lambda batches: per_text(batches, to_arrow_schema(out), lambda t: (signed(fingerprint(t)),), text), out)


@lru_cache
def cosets(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of low 12 bits, of high 11 bits, first pattern of each syndrome, patterns, their excess over the radius).

    Adding a pattern of its syndrome to a block gives an anchor; patterns of a syndrome are in order of weight.
    """

    def remainder(x: int) -> int:
        for i in reversed(range(CHECKS, LENGTH)):
            if x >> i & 1:
                x ^= GOLAY << (i - CHECKS)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    patterns, excess = [], []
    for weight in range(RADIUS + extra + 1):
        for at in itertools.combinations(range(LENGTH), weight):
            patterns.append(sum(1 << i for i in at))
            excess.append(max(0, weight - RADIUS))
    p = np.array(patterns, np.int64)
    s = low[p & 4095] ^ high[p >> 12]
    order = np.argsort(s, kind="stable")
    return low, high, np.searchsorted(s[order], np.arange((1 << CHECKS) + 1)), p[order], np.array(excess, np.int64)[order]


def anchors(fps: np.ndarray, blocks: tuple[int, ...], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor, whether it is the row's home) of all homes and replicas over ``blocks``."""
    extra = threshold * len(blocks) // len(BLOCKS)
    low, high, first, patterns, excess = cosets(extra)
    row, key, over = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    for b in blocks:
        start, bits = BLOCKS[b]
        part = ((fps[row] >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = low[part & 4095] ^ high[part >> 12]
        n = first[s + 1] - first[s]
        pick = np.repeat(first[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, key, over = np.repeat(row, n), np.repeat(key, n), np.repeat(over, n)
        key = key << LENGTH | np.repeat(part, n) ^ patterns[pick]
        over = over + excess[pick]
        ok = over <= extra
        row, key, over = row[ok], key[ok], over[ok]
    return row, key, over == 0


def forest(homes: np.ndarray, all_: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between ``homes`` and ``all_`` connect."""
    nodes = np.unique(np.concatenate([homes, all_]))
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // len(nodes))
    for i in range(0, len(homes), step):
        near = np.bitwise_count(homes[i : i + step, None] ^ nodes[None, :]) <= threshold
        for j in np.nonzero(near.sum(1) > 1)[0]:
            old = np.unique(label[near[j]])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return [(int(nodes[k]), int(nodes[label[k]])) for k in moved]


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` whose components are those of all links within ``threshold``."""
    fps = materialise(fps.select("fp").distinct())
    n = fps.count()
    sets = tuple(itertools.combinations(range(len(BLOCKS)), 1 if n <= SINGLE_MOST else 2))

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, blocks in enumerate(sets):
                    row, key, home = anchors(x, blocks, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(key | k << 2 * LENGTH), pa.array(x[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    placed = fps.mapInArrow(place, "anchor long, fp long, home boolean")
    homes = fps.mapInArrow(lambda b: (r.filter(r.column(2)) for r in place(b)), "anchor long, fp long, home boolean").groupBy("anchor").count()
    crowded = materialise(homes.filter(F.col("count") > PART_HOMES).select(F.col("anchor").alias("c"), F.ceil(F.col("count") / PART_HOMES).cast("int").alias("parts")))
    if crowded.limit(1).count():
        placed = placed.join(crowded, F.col("anchor") == F.col("c"), "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        placed = placed.withColumn("own", own).select("anchor", "fp", (F.col("home")).alias("h"), "own", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        placed = placed.select("anchor", "part", "fp", (F.col("h") & (F.col("own") == F.col("part"))).alias("home"))
    else:
        placed = placed.select("anchor", F.lit(0).alias("part"), "fp", "home")
    dealt = placed.repartition(partitions_for(placed), "anchor", "part").sortWithinPartitions("anchor", "part")

    def compare(batches):
        """Reads buckets one after the other; holds one bucket."""
        key, homes_, all_ = None, [], []

        def done():
            if not homes_:
                return
            h, x = np.concatenate(homes_), np.concatenate(all_)
            if len(h) and len(x) > 1 and (edges := forest(h, x, threshold)):
                a, b = np.array(edges, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.copy().view(np.int64)), pa.array(b.copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            anchor, part, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            cuts = np.nonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))[0] + 1
            for i, j in zip([0, *cuts], [*cuts, len(anchor)], strict=True):
                if i == j:
                    continue
                if (anchor[i], part[i]) != key:
                    yield from done()
                    key, homes_, all_ = (anchor[i], part[i]), [], []
                homes_.append(fp[i:j][home[i:j]])
                all_.append(fp[i:j])
        yield from done()

    return dealt.mapInArrow(compare, "a long, b long")


def cluster_documents(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` but the text, then ``fp`` and ``component_id`` (smallest id that links reach)."""
    rest = make_room(docs, "fp", "component_id", text).columns
    # input columns travel in one struct, so their names can't clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("string").alias("_end")).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = materialise(fingerprints(packed))
    groups = components(links(known, threshold))
    firsts = known.groupBy(F.col("fp").alias("f")).agg(F.min("id").alias("first"))
    rooted = firsts.join(groups, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("root", "f").alias("r"))
    whole = rooted.groupBy(F.col("r").alias("w")).agg(F.min("first").alias("component_id"))
    label = rooted.join(whole, F.col("r") == F.col("w")).select("f", "component_id")
    return known.join(label, F.col("fp") == F.col("f")).select(*[F.col("row")[c].alias(c) for c in rest], "fp", "component_id")


def first_rows(docs: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Of each group of texts the row with the smallest id (then text hash) stays, once; so do all rows without an id.

    ``groups`` (node, root) link hashes of texts; equal texts are a group of their own. Rows are told apart by id and text, so a text
    that shares its id with a copy stays. Only rows that may go take part in a shuffle.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), text_key(text))
    rooted = rows.join(groups, F.col("t") == F.col("node"), "left").select("id", "t", F.coalesce("root", "t").alias("r"))
    best = rooted.groupBy("r").agg(F.min(F.struct("id", "t")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "best")
    met = rooted.join(best, "r").groupBy("id", "t").agg(F.first(F.struct("id", "t") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n"))
    met = materialise(met.filter("not stays or n > 1").select(F.col("id").alias("met_id"), F.col("t").alias("met_t"), "stays"))
    marked = fl.may_hold(docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), text_key(text)), "t", met, "met_t")
    free = marked.filter(~F.col("_may") | F.col("id").isNull()).select("row.*")
    joined = marked.filter(F.col("_may") & F.col("id").isNotNull()).join(met, (F.col("id") == F.col("met_id")) & (F.col("t") == F.col("met_t")), "left")
    alone = joined.filter("stays is null").select("row.*")
    return free.unionByName(alone).unionByName(joined.filter("stays").dropDuplicates(["id", "t"]).select("row.*"))


def text_key(text: str):
    return F.xxhash64(text).alias("t")


def drop_near_copies(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose fingerprint is linked to a row of a smaller id; rows without an id stay."""
    return first_rows(docs, components(near_edges(docs, threshold, text)), text, doc_id)


def near_edges(docs: DataFrame, threshold: int, text: str) -> DataFrame:
    """(a, b): hashes of texts; each text is tied to the first of its component of fingerprints."""
    known = materialise(fingerprints(docs.select(text_key(text), F.col(text).alias("text"))).distinct())
    return tied(known.select("t", F.col("fp").alias("h")), components(links(known, threshold)))


def tied(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b) from rows (t, h) and components (node, root) of h: the smallest t of the component, and each t."""
    rooted = rows.join(groups, F.col("h") == F.col("node"), "left").select("t", F.coalesce("root", "h").alias("r"))
    firsts = rooted.groupBy(F.col("r").alias("w")).agg(F.min("t").alias("a"))
    return rooted.join(firsts, F.col("r") == F.col("w")).select("a", F.col("t").alias("b"))


def word_shingle(w, i):
    """Hash of the SIMILAR_WORDS words at place ``i``, of fewer at a short text's end."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(SIMILAR_WORDS)])


def word_sets(text):
    """The hashed word shingles of a text in lower case; a shorter text is its own only shingle."""

    def of(w):
        last = F.greatest(F.size(w) - SIMILAR_WORDS, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: word_shingle(w, i))

    return F.array_distinct(let(words(F.lower(text)), of))


def similar_edges(docs: DataFrame, text: str) -> DataFrame:
    """(a, b): hashes of texts; each text that is linked to another by a Jaccard similarity of 0.8 or more is tied to the first of its group.

    Candidates come from MinHash buckets (0.995 of the pairs at 0.8) and are checked by their whole shingle sets. Only texts that share a
    bucket are kept for that.
    """
    worded = docs.select(text_key(text), words(F.lower(F.col(text))).alias("w")).filter(F.size("w") > 0)
    places = worded.select(F.col("t").alias("h"), "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - SIMILAR_WORDS, F.lit(0)))).alias("p"))
    members = materialise(fl.buckets(fl.minima(places.select("h", word_shingle(F.col("w"), F.col("p")).alias("x")))))
    some = fl.may_hold(docs.select(text_key(text), F.col(text).alias("code")), "t", members, "h").filter("_may")
    texts = some.groupBy(F.col("t").alias("h")).agg(F.first("code").alias("code"))
    groups = fl.linked(members, texts.join(members.select("h").distinct(), "h", "left_semi"), word_sets)
    return groups.select(F.col("root").alias("a"), F.col("node").alias("b"))


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that near fingerprints or a Jaccard similarity of 0.8 link to a row of a smaller id."""
    edges = near_edges(docs, THRESHOLD, text).union(similar_edges(docs, text))
    return first_rows(docs, components(edges), text, doc_id)
