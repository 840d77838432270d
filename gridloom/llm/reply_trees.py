"""Reply trees to training conversations, in DataFrame expressions only.

Messages form trees through ``parent_id``. Root-to-leaf paths are enumerated by self-joins over jump
pointers (parent, grandparent, 4th, 8th ... ancestor): both the pointers and the paths need as many joins as
the depth has binary digits, and the rows made are those of the paths themselves. Branches of a tree are
ranked by the mean score of their messages, and each chosen path becomes one formatted conversation with
a loss mask over what the assistant says.

Template, per turn: ``<|role|>text<|end|>``, role and text escaped. Escaping doubles each backslash and
puts one behind the first character of every control string, so that none is left in a text and
dropping each escaping backslash gives the text back.

Defined results: null text and null role are empty strings; a null score is 0; ties between branches go to
the smaller leaf id; a message whose parent is absent is a root, and messages of or under a parent cycle belong to no path; repeated rows (same tree and id)
should be numbered apart by the caller, as ``from_turns`` does; texts of any length are formatted whole; an empty table gives no rows; columns
beyond those named are left out, so no names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import let, materialise

END = "<|end|>"
#: Strings that chat templates in public use give a meaning to.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def from_turns(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it."""
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    df = turns.select(F.col(tree).alias("tree_id"), F.row_number().over(order).cast("long").alias("message_id"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return df.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame) -> DataFrame:
    """Rows (tree_id, leaf_id, message_id, up) with up = steps from the leaf, for all root-to-leaf paths."""
    ids = messages.select("tree_id", "message_id", "parent_id")
    known = ids.select(F.col("tree_id").alias("kt"), F.col("message_id").alias("km"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    jump = ids.join(known, same("tree_id", "kt") & (F.col("parent_id") == F.col("km"))).select("tree_id", "message_id", F.col("km").alias("to"))
    jumps = [materialise(jump)]  # the k-th has the messages with a 2**k-th ancestor only
    most = messages.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 1  # no path is longer
    while 2 ** (len(jumps) - 1) < most and jumps[-1].limit(1).count():
        far = jumps[-1].select(F.col("tree_id").alias("ft"), F.col("message_id").alias("fm"), F.col("to").alias("far"))
        jumps.append(materialise(jumps[-1].join(far, same("tree_id", "ft") & (F.col("to") == F.col("fm"))).select("tree_id", "message_id", F.col("far").alias("to"))))
    parents = jumps[0].select(F.col("tree_id").alias("pt"), F.col("to").alias("pm")).distinct()
    endless = jumps[-1].select(F.col("tree_id").alias("pt"), F.col("message_id").alias("pm"))  # above them is a cycle
    out = ids.join(parents.union(endless), same("tree_id", "pt") & (F.col("message_id") == F.col("pm")), "left_anti")
    out = out.select("tree_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps) - 1)):
        step = jumps[k].select(F.col("tree_id").alias("st"), F.col("message_id").alias("sm"), "to")
        out = out.join(step, same("tree_id", "st") & (F.col("message_id") == F.col("sm")), "left")
        out = out.select("tree_id", "leaf_id", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("message_id", "up"))).otherwise(F.array(F.struct("message_id", "up"), F.struct(F.col("to").alias("message_id"), (F.col("up") + 2**k).alias("up"))))).alias("p")).select("tree_id", "leaf_id", "p.*")
    return out


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of each tree: tree_id, leaf_id, rank, score, turns (role, text in order)."""
    said = messages.select(F.col("tree_id").alias("mt"), F.col("message_id").alias("mm"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = paths(messages).join(said, F.col("tree_id").eqNullSafe(F.col("mt")) & (F.col("message_id") == F.col("mm")))
    whole = rows.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    return whole.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)


def format_conversations(chosen: DataFrame) -> DataFrame:
    """tree_id, leaf_id, rank, ``formatted`` and ``loss``: spans (start from 0, length) in code points under the loss mask."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        here = acc["at"] + F.length(p["head"])
        span = F.struct(here.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((here + F.length(p["body"]) + len(END)).alias("at"), F.when(p["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    out = let(parts, lambda a: F.struct(F.array_join(F.transform(a, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), F.aggregate(a, start, add)["spans"].alias("loss")))
    return chosen.select("tree_id", "leaf_id", "rank", out.alias("o")).select("tree_id", "leaf_id", "rank", "o.*")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "<\\|end\\|>", -1), lambda x: x != "")
    cut = lambda x: F.instr(F.substr(x, F.lit(3)), "|>")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substr(x, F.lit(3), cut(x) - 1)).alias("role"), unescape(F.substr(x, cut(x) + 4)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped, without anything between."""
    return let(formatted, lambda f: F.array_join(F.transform(loss, lambda s: unescape(F.substr(f, s["start"] + 1, s["length"]))), ""))
