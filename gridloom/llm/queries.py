"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fuzzy_lines as fl, interpolated_lm as lm, language_bitmask as lb, latent_leaks as ll, piece_codec as pc, pseudonyms as ps, quality_rules as qr, reply_trees as rt, simhash_cover as sc, suffix_merge as sm
from ._shared import read_table

#: Key of the pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = "gridloom"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ll.find_leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = lb.learn(docs.filter(~held_out), F.col("doc_id"))
    return lb.predict_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.cluster_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(7) == 2, F.lit(False))
    return lm.score_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"), F.coalesce(fold(7) == 5, F.lit(False)))


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sm.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pc.encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    size = lambda c: F.octet_length(c).cast("long")
    return out.select("doc_id", F.floor(size("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymise_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.count_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qr.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sql() -> str:
    """The same fit in SQL: one pair of CTEs for each step."""
    rules, start = qr.RULES, qr.START
    votes = [f"CASE WHEN {stat} <= {good!r} THEN 1 WHEN {stat} > {bad!r} THEN -1 ELSE 0 END AS v{j}" for j, (_, stat, good, bad) in enumerate(rules)]
    vs = ", ".join(f"v{j}" for j in range(len(rules)))

    def odds(m: str) -> str:
        each = [f"CASE v{j} WHEN 1 THEN {m}.g{j} WHEN -1 THEN {m}.b{j} ELSE 0 END" for j in range(len(rules))]
        return f"{m}.base + " + " + ".join(each)

    import math

    g, b = start["good"], start["bad"]
    first = ", ".join(f"{max(math.log(g[2] / b[2]), 0.0)!r}::DOUBLE AS g{j}, {min(math.log(g[0] / b[0]), 0.0)!r}::DOUBLE AS b{j}" for j in range(len(rules)))
    ctes = [f"m0 AS (SELECT {math.log(qr.START_GOOD) - math.log(1 - qr.START_GOOD)!r}::DOUBLE AS base, {first})"]
    for k in range(qr.STEPS):
        sums = ", ".join(f"sum(CASE WHEN v{j} = {v} THEN q * n ELSE 0 END) AS sg{j}_{i}, sum(CASE WHEN v{j} = {v} THEN (1 - q) * n ELSE 0 END) AS sb{j}_{i}" for j in range(len(rules)) for i, v in ((0, -1), (2, 1)))
        ctes.append(f"e{k} AS (SELECT sum(q * n) AS wg, sum((1 - q) * n) AS wb, sum(n) AS t, {sums} FROM (SELECT p.*, 1 / (1 + exp(-({odds(f'm{k}')}))) AS q FROM patterns p, m{k}))")
        w = qr.PRIOR_WEIGHT
        ratio = lambda j, i: f"ln(((sg{j}_{i} + {w} * t * {g[i]}) / (wg + {w} * t)) / ((sb{j}_{i} + {w} * t * {b[i]}) / (wb + {w} * t)))"  # noqa: E731, B023
        good = f"((wg + {w} * t * {qr.START_GOOD}) / (t + {w} * t))"
        each = ", ".join(f"greatest({ratio(j, 2)}, 0) AS g{j}, least({ratio(j, 0)}, 0) AS b{j}" for j in range(len(rules)))
        ctes.append(f"m{k + 1} AS (SELECT ln({good}) - ln(1 - {good}) AS base, {each} FROM e{k})")
    last = f"m{qr.STEPS}"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM documents),
tokens AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM tokens),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dups) GROUP BY doc_id),
facts AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\t-\\r]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[\\p{{L}}\\p{{Nd}} \\t-\\r]', '', 'g')) AS n_others,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts
  FROM base b LEFT JOIN covered c USING (doc_id)),
shares AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbol_share, n_others / greatest(word_chars, 1) AS non_letter_share, word_chars / greatest(n_words, 1) AS mean_word_chars,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
         n_upper / greatest(word_chars, 1) AS capital_share, n_shouts / greatest(n_words, 1) AS shout_share,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM facts),
voted AS (SELECT *, {", ".join(votes)} FROM shares),
patterns AS (SELECT {vs}, count(*) AS n FROM voted GROUP BY ALL),
{", ".join(ctes)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds(last)}))) >= {qr.KEEP_AT} AS kept
FROM voted, {last}"""


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = rt.format_conversations(rt.conversations(rt.from_turns(given.unionByName(extra))))
    read = formatted.select("tree_id", "formatted", rt.parse(F.col("formatted")).alias("turns"), rt.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    heard = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(heard, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_sql() -> str:
    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for x in rt.CONTROLS:
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length({escaped("role")}) + length({escaped("text")}) + {len(rt.END)})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""


def queries() -> dict:
    return {"op1_latent_leaks": op1_latent_leaks, "op2_language_bitmask": op2_language_bitmask, "op3_fuzzy_lines": op3_fuzzy_lines, "op4_quality_rules": op4_quality_rules, "op5_simhash_cover": op5_simhash_cover, "op9_interpolated_lm": op9_interpolated_lm, "op6_suffix_merge": op6_suffix_merge, "op7_piece_codec": op7_piece_codec, "op8_pseudonyms": op8_pseudonyms, "op10_reply_trees": op10_reply_trees}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": op4_sql(), "op10_reply_trees": op10_sql()}
