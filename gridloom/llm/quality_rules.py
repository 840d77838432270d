"""Quality filtering by weak supervision, in DataFrame expressions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0). No rule decides
alone: a two-class latent model with class-conditional vote probabilities is fitted by expectation
maximisation on the counts of vote patterns over *all* rows, and a row's posterior probability of being
good replaces the usual all-must-pass filter. Patterns number at most ``3 ** len(RULES)`` whatever the
corpus, so that table is the only thing that reaches the driver.

The E-step uses the constrained model: a rule's vote never counts against its own sense and an abstention counts nothing, so a learned ratio
of the wrong sign is zero there.

Defined results: null or empty text has no words, fails the base check and is not kept; very long texts are read whole; repeated rows are
judged one by one; at a tie (probability 0.5) a row is kept; an empty table gives an empty result; input columns travel in one struct (``row``), so
their names can't clash with the operator's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import let, materialise, words

#: (name, statistic, good if at most, bad if above); a text between the two gets no vote.
RULES = (
    ("symbols", "symbol_share", 0.02, 0.10),
    ("non_letters", "non_letter_share", 0.06, 0.10),
    ("long_words", "mean_word_chars", 9.0, 12.0),
    ("dup_lines", "dup_line_share", 0.05, 0.30),
    ("repeats", "repeat_share", 0.02, 0.12),
    ("capitals", "capital_share", 0.15, 0.40),
    ("shouting", "shout_share", 0.05, 0.30),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACES_ONE = "[ \\t-\\r]"
STEPS, KEEP_AT = 12, 0.5
#: Start of the fit, P(vote | class) for votes -1, 0, 1; also its Dirichlet prior, worth this share of the rows.
START = {"good": (0.002, 0.048, 0.95), "bad": (0.30, 0.10, 0.60)}
START_GOOD, PRIOR_WEIGHT = 0.85, 0.05


def repeated_words(w: Column) -> Column:
    """How many of the words ``w`` lie in a window of WINDOW words that the same array holds twice or more."""

    def from_sorted(s: Column) -> Column:
        twin = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        at = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(p, k + 1) - x))), F.lit(0), lambda a, b: a + b))

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, from_sorted))

    def windows(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WINDOW)]))

    return let(w, lambda a: F.when(F.size(a) <= WINDOW, F.lit(0)).otherwise(let(windows(a), from_hashes)))


def with_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns), the base statistics, and one vote column ``vote_<rule>`` per rule."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), t.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    facts = let(words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    line_facts = let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    df = df.select(
        "row",
        facts.alias("f"),
        line_facts.alias("l"),
        F.length(F.regexp_replace("t", SPACES_ONE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}", ""))).alias("n_upper"),
        F.length(F.regexp_replace("t", "[\\p{L}\\p{Nd} \\t-\\r]", "")).alias("n_others"),
        (F.length("t") - F.length(F.regexp_replace("t", "[!?]", ""))).alias("n_shouts"),
    )
    df = df.select("row", "f.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "f.n_repeat_words", "l.n_lines", "n_upper", "n_others", "n_shouts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = {
        "symbol_share": F.col("n_symbols") / n,
        "non_letter_share": F.col("n_others") / F.greatest(F.col("word_chars"), F.lit(1)),
        "mean_word_chars": F.col("word_chars") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "capital_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "shout_share": F.col("n_shouts") / n,
    }
    votes = [F.when(shares[stat] <= good, 1).when(shares[stat] > bad, -1).otherwise(0).alias(f"vote_{name}") for name, stat, good, bad in RULES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *votes)


@dataclass(frozen=True)
class VoteModel:
    """P(good) and, per rule, log P(vote | good) - log P(vote | bad) for the votes -1, 0, 1."""

    good: float
    ratios: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.good) - math.log(1 - self.good))
        for (name, *_), (bad, none, good) in zip(RULES, self.ratios, strict=True):
            v = F.col(f"vote_{name}")
            odds = odds + F.when(v == 1, good).when(v == -1, bad).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(voted: DataFrame) -> VoteModel:
    """Expectation maximisation on the pattern counts of ``voted``.

    A vote must not speak against its own sense: a ratio of the wrong sign counts as zero.
    """
    names = [f"vote_{r[0]}" for r in RULES]
    patterns = [(r[:-1], r[-1]) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** len(RULES) rows
    total = sum(n for _, n in patterns)
    good, p = START_GOOD, {c: [list(START[c]) for _ in RULES] for c in START}

    def model() -> VoteModel:
        rows = []
        for g, b in zip(p["good"], p["bad"], strict=True):
            r = [math.log(x / y) for x, y in zip(g, b, strict=True)]
            rows.append((min(r[0], 0.0), 0.0, max(r[2], 0.0)))
        return VoteModel(good, tuple(rows))

    for _ in range(STEPS if total else 0):
        now = model()
        base = math.log(now.good) - math.log(1 - now.good)
        weight = {"good": 0.0, "bad": 0.0}
        seen = {c: [[0.0, 0.0, 0.0] for _ in RULES] for c in START}
        for votes, n in sorted(patterns):
            odds = base
            for v, r in zip(votes, now.ratios, strict=True):
                odds += r[v + 1]
            q = 1 / (1 + math.exp(-odds))
            for c, share in (("good", q * n), ("bad", (1 - q) * n)):
                weight[c] += share
                for j, v in enumerate(votes):
                    seen[c][j][v + 1] += share
        prior = PRIOR_WEIGHT * total
        for c in START:
            p[c] = [[(s + prior * START[c][i]) / (weight[c] + prior) for i, s in enumerate(row)] for row in seen[c]]
        good = (weight["good"] + prior * START_GOOD) / (total + prior)
    return model()


def judge(voted: DataFrame, model: VoteModel) -> DataFrame:
    """``voted`` with ``p_good`` and ``kept``."""
    df = voted.withColumn("p_good", model.posterior())
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Rows go to the checkpoint folder with their votes, so that these are computed once."""
    voted = materialise(with_votes(docs, text).select("row", "base_failed", *[f"vote_{r[0]}" for r in RULES]))
    return judge(voted, fit(voted)).filter("kept").select("row.*")


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics, votes, ``p_good`` and ``kept`` for each row of ``docs`` (columns but ``text`` in ``row``)."""
    keep = [c for c in docs.columns if c != text]
    voted = with_votes(docs, text).withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]) if keep else F.struct(F.lit(None).cast("string").alias("none")))
    voted = materialise(voted)
    return judge(voted, fit(voted))
