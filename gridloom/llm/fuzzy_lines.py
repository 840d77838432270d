"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

Lines with a word (lower case, trimmed) that are equal, or whose sets of SHINGLE-character
shingles have a Jaccard similarity of THRESHOLD or more, are linked; of each component the first line (smallest document
id, then line number) stays, all others are removed from their documents. A line shorter than
a shingle is its own only shingle. Blank lines are never touched.

1. Equal lines are combined before and after one shuffle. Each shingle of a distinct line is hashed once; the j-th signature
   value is the minimum of these hashes after XOR with the j-th constant, which ranks the shingles by closeness to that
   constant. The first CLASS_BITS bits decide before all others, so the shingles are first reduced by these bits (their class) to one
   minimum for each of the few constants of a class, and the signature is the minimum over the classes that a line has: the same
   values as of all constants over all shingles, at 8 comparisons a shingle instead of 60.
2. Bands of ROWS values are bucket keys. Each value is in two bands, any two bands share one value at most. A pair at the threshold shares a
   bucket with probability 0.995 (by simulation, 225 shingles in both; 0.998 for 20).
3. In each bucket the first PIVOTS lines are compared with all others. A pair first has to pass an exact bound: the odd sketches of two sets
   (one bit flipped for each shingle) differ in no more bits than the sets differ in shingles, so a pair whose sketches differ in more than
   (1 - t) / (1 + t) of both sizes is not similar, and no similar pair is lost. What is left is checked by the Jaccard
   similarity of the whole shingle sets; no pair is checked twice. Buckets that are not one component by then go on with the next
   lines as pivots, GROWTH times as many each time, until every pair of a bucket is compared or connected.
4. Connected components of the verified links decide.

A bitmap of fixed size (FILTER_BITS) is broadcast to leave rows out of later shuffles that can't match; as it
fills up it lets more rows pass, never too few. Lines are known by 64-bit hashes between the steps.

Defined results: null text stays null and has no lines; empty and blank texts lose nothing; lines and texts of any length are read whole; a tie
(equal lines of one document) keeps the smaller line number; rows equal in id and text are one document; a null id
counts as largest; an empty table gives no rows; ``drop_lines`` returns all input columns untouched but the text, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._graph import components
from ._shared import let, materialise, partitions_for, release

SHINGLE, THRESHOLD = 5, 0.8
ROWS, GROUPS, CLASS_BITS = 6, 10, 3
SKETCH_WORDS = 16  # of 64 bits
PIVOTS, GROWTH = 1, 32
FILTER_BITS = 1 << 23
LAST_ID = 2**63 - 1
#: For each class the same constants of LOW_BITS, far apart: their first bits count them.
LOW_BITS = 60
LOWS = [i << (LOW_BITS - CLASS_BITS) | int.from_bytes(hashlib.sha256(b"minhash %d" % i).digest()[:8], "big") >> (64 - LOW_BITS + CLASS_BITS) for i in range(1 << CLASS_BITS)]
#: (class, place in LOWS) of each value. The values of a row of bands come from three classes: lines that differ in few shingles are equal in some.
PLACES = [(t, [(3 * (i // ROWS) + i % ROWS // 2) % (1 << CLASS_BITS) for i in range(j)].count(t)) for j in range(ROWS * GROUPS) for t in [(3 * (j // ROWS) + j % ROWS // 2) % (1 << CLASS_BITS)]]
#: The values lie in GROUPS rows of ROWS; bands are the rows and the diagonals.
BANDS = [[(i + step * k) % GROUPS * ROWS + k for k in range(ROWS)] for step in (0, 1) for i in range(GROUPS)]


def document_key(text: str, doc_id: str) -> list[Column]:
    """(doc, dk): the id, largest for null, and a hash that tells rows of one id apart."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(doc_id, text).alias("dk")]


def line_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, dk, line_no, line): all lines that take part."""
    df = docs.filter(F.col(text).isNotNull()).select(*document_key(text, doc_id), F.posexplode(F.split(F.lower(text), "\n", -1)).alias("line_no", "raw"))
    return df.select("doc", "dk", "line_no", F.trim("raw").alias("line")).filter(F.btrim("line", F.lit(" \t\n\x0b\f\r")) != "")


def line_hash() -> Column:
    return F.xxhash64("line").alias("h")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """(h, code): each line once; code is UTF-16, so that a shingle is a slice. Equal lines are combined before the shuffle."""
    return rows.select(line_hash(), "line").groupBy("h").agg(F.first("line").alias("line")).select("h", F.encode("line", "UTF-16BE").alias("code"))


def minima(rows: DataFrame) -> DataFrame:
    """(h, m0, m1, ...) from ``rows`` (h, x) of hashed shingles: for each constant the smallest hash after XOR with it."""
    low = F.col("x").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    classes = rows.groupBy("h", F.shiftrightunsigned("x", 64 - CLASS_BITS).alias("t")).agg(*[F.min(low.bitwiseXOR(F.lit(c))).alias(f"v{i}") for i, c in enumerate(LOWS)])
    return classes.groupBy("h").agg(*[F.min(F.shiftleft(F.col("t").bitwiseXOR(F.lit(t)), LOW_BITS).bitwiseOR(F.col(f"v{i}"))).alias(f"m{j}") for j, (t, i) in enumerate(PLACES)])


def signatures(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ...): the minima of each of the distinct ``lines`` (h, code)."""
    last = F.greatest(F.octet_length("code") / 2 - SHINGLE, F.lit(0)).cast("int")
    places = lines.select("h", "code", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    return minima(places.select("h", F.xxhash64(F.substr("code", F.col("p") * 2 + 1, F.lit(2 * SHINGLE))).alias("x")))


def buckets(signed: DataFrame) -> DataFrame:
    """(key, h, rank) from signatures: the members of each bucket with two or more, numbered from 0."""
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{j}") for j in band]) for b, band in enumerate(BANDS)]
    rows = signed.select("h", F.explode(F.array(*keys)).alias("key"))
    # most keys have one row: these go after a sort by the key alone, the few others are put in order
    met = rows.select("key", "h", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("times")).filter("times > 1")
    return met.select("key", "h", (F.row_number().over(Window.partitionBy("key").orderBy("h")) - 1).alias("rank"))


def shingles(line: Column) -> Column:
    """The set of a line's shingles, hashed. The UTF-16 code is bound first: reading a binary column copies it."""

    def of(c: Column) -> Column:
        last = F.greatest(F.octet_length(c) / 2 - SHINGLE, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substr(c, i * 2 + 1, F.lit(2 * SHINGLE))))

    return F.array_distinct(let(F.encode(line, "UTF-16BE"), of))  # outside of lambdas, so in generated code


def sketched(sets: DataFrame) -> DataFrame:
    """(h, n, s): size and odd sketch of each of ``sets`` (h, x), whose x is an array of distinct longs."""
    # no set is empty; explode() would make Spark add a filter on the set's size, for which it makes each set once more
    rows = sets.select("h", F.explode_outer("x").alias("v"))
    rows = rows.select("h", F.shiftrightunsigned("v", 6).bitwiseAND(F.lit(SKETCH_WORDS - 1)).cast("int").alias("word"), F.expr("shiftleft(1L, int(v & 63))").alias("bit"))
    # if() stays in local variables; CASE writes to fields, which takes several times as long
    words = [F.bit_xor(F.expr(f"if(word = {k}, bit, 0L)")).alias(f"s{k}") for k in range(SKETCH_WORDS)]
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *words).select("h", "n", F.struct(*[f"s{k}" for k in range(SKETCH_WORDS)]).alias("s"))


def may_be_alike(a: str, an: str, b: str, bn: str) -> Column:
    """False only for pairs below the threshold: sketches can't differ in more bits than the sets do in members."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH_WORDS)])
    return (1 + THRESHOLD) * apart <= (1 - THRESHOLD) * (F.col(an) + F.col(bn)) + 1e-6


def verified(pairs: DataFrame, lines: DataFrame, sets=shingles) -> DataFrame:
    """The written ``pairs`` (a, b) of ``lines`` (h, code) with the column ``same``: whether the ``sets`` of their codes are similar enough."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("x"))
    some = may_hold(lines, "h", named, "x").filter("_may")
    coded = lambda k: some.select(F.col("h").alias(k), F.col("code").alias(f"c{k}"))
    got = pairs.join(coded("a"), "a").join(coded("b"), "b")
    # columns of their own, which Spark does not inline as they are used twice; not bound by let(), where they would run outside of generated code
    found = got.select("a", "b", sets(F.col("ca")).alias("x"), sets(F.col("cb")).alias("y"))
    found = found.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return found.select("a", "b", (F.col("both") >= THRESHOLD * (F.col("n") - F.col("both"))).alias("same"))


def may_hold(df: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """``df`` with the column ``_may``, true for every row whose key ``members`` holds and few others."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    bits = members.select(at(member).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    # FILTER_BITS / 32768 rows of 4 KB: one megabyte, whatever the input
    joined = df.withColumn("_p", at(key)).join(F.broadcast(bits), F.expr("bitmap_bucket_number(_p)") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substr("bits", (F.expr("bitmap_bit_position(_p)") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, int(bitmap_bit_position(_p) % 8)) & 1") == 1, F.lit(False))
    return joined.withColumn("_byte", byte).withColumn("_may", hit).drop("_p", "bucket", "bits", "_byte")


def line_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(node, root): the component of each line hash that is linked to another."""
    members = materialise(buckets(signatures(distinct_lines(line_rows(docs, text, doc_id)))))
    rows = may_hold(line_rows(docs, text, doc_id).select("line", line_hash()), "h", members, "h").filter("_may")
    lines = rows.groupBy("h").agg(F.first("line").alias("code"))
    groups = linked(members, lines.join(members.select("h").distinct(), "h", "left_semi"))
    release(members)
    return groups


def linked(members: DataFrame, lines: DataFrame, sets=shingles) -> DataFrame:
    """(node, root) from the buckets ``members`` (key, h, rank) and ``lines`` (h, code), whose ``sets`` are compared. What a round wrote goes with it."""
    lines = materialise(lines)
    sketches = materialise(sketched(lines.select("h", sets(F.col("code")).alias("x"))))
    # one label for each line so far; links found later join labels
    live, tested, lo, hi = members.withColumn("root", F.col("h")), None, 0, PIVOTS
    while True:
        left = materialise(live.join(sketches, "h"))
        if tested is not None:
            release(live)
        tested = compared(left, tested, lines, sets, lo, hi)
        groups = components(gathered(tested).filter("same"))
        live = unfinished(left, groups, hi)
        release(left)
        if live.isEmpty():
            release(lines, sketches, tested, live)
            return groups
        lo, hi = hi, hi * GROWTH


def compared(left: DataFrame, tested: DataFrame | None, lines: DataFrame, sets, lo: int, hi: int) -> DataFrame:
    """``tested`` (a, b, same) and the pairs of the pivots lo..hi-1 of each bucket with the lines behind them that have another label."""
    pivots = left.filter((F.col("rank") >= lo) & (F.col("rank") < hi)).select(F.col("key").alias("pk"), F.col("h").alias("ph"), F.col("root").alias("pr"), F.col("rank").alias("pr_rank"), F.col("n").alias("pn"), F.col("s").alias("ps"))
    meet = (F.col("key") == F.col("pk")) & (F.col("rank") > F.col("pr_rank")) & (F.col("root") != F.col("pr")) & may_be_alike("s", "n", "ps", "pn")
    pairs = left.join(pivots, meet).select(F.least("ph", "h").alias("a"), F.greatest("ph", "h").alias("b")).distinct()
    if tested is not None:  # two lines may meet in several buckets
        pairs = pairs.join(gathered(tested), ["a", "b"], "left_anti")
    pairs = materialise(pairs)
    more = verified(pairs, lines, sets)
    out = materialise(more if tested is None else gathered(tested).union(more))
    release(pairs, *([] if tested is None else [tested]))
    return out


def gathered(tested: DataFrame) -> DataFrame:
    """``tested`` in no more partitions than the session's: splits of skewed joins and unions of rounds would else add up to thousands."""
    return tested.coalesce(partitions_for(tested))


def unfinished(left: DataFrame, groups: DataFrame, hi: int) -> DataFrame:
    """(key, h, rank, root) of the buckets that hold lines that have not been pivots, and more than one component."""
    rows = left.select("key", "h", "rank").join(left.filter(F.col("rank") == hi).select("key"), "key", "left_semi")
    rows = rows.join(groups, F.col("h") == F.col("node"), "left").select("key", "h", "rank", F.coalesce("root", "h").alias("root"))
    split = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    return materialise(rows.join(split, "key", "left_semi"))


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, dk, gone): the numbers of the lines that each document loses, for documents that lose any."""
    groups = materialise(line_components(docs, text, doc_id))
    rows = line_rows(docs, text, doc_id).select("doc", "dk", "line_no", line_hash())
    rows = rows.join(groups, F.col("h") == F.col("node"), "left").select(F.coalesce("root", "h").alias("c"), F.struct("doc", "dk", "line_no").alias("at"))
    first = rows.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1").select("c", "first")
    gone = rows.join(first, "c").filter(F.col("at") != F.col("first"))
    # repeated rows name their lines more than once
    return gone.groupBy(F.col("at.doc").alias("doc"), F.col("at.dk").alias("dk")).agg(F.sort_array(F.collect_set("at.line_no")).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in the sorted array ``gone``."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; documents that lose nothing take no part in the last join."""
    gone = materialise(removals(docs, text, doc_id).withColumnRenamed("doc", "gone_doc").withColumnRenamed("dk", "gone_dk"))
    rows = docs.select(F.struct("*").alias("row"), *document_key(text, doc_id))
    rows = may_hold(rows, "dk", gone, "gone_dk")
    back = lambda new: [F.col("row")[c].alias(c) if c != text else new.alias(text) for c in docs.columns]
    hit = rows.filter(F.col("_may") & F.col("row")[text].isNotNull()).join(gone, (F.col("dk") == F.col("gone_dk")) & (F.col("doc") == F.col("gone_doc")), "left")
    hit = hit.select(*back(F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(without(F.col("row")[text], F.col("gone")))))
    return hit.unionByName(rows.filter(~F.col("_may") | F.col("row")[text].isNull()).select(*back(F.col("row")[text])))


def count_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers (from 0) of the removed lines of each row."""
    gone = removals(docs, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *document_key(text, doc_id), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(gone, ["doc", "dk"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))
