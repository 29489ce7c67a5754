"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all
turns before it as context, and only that reply under the loss mask.

Only DataFrame functions are used. Defined results: null text or role is empty; turns sort by
(turn, role, text) with null first, so repeated rows stay and keep a fixed order; a null conv_id is a
conversation; an empty table gives no rows. A conversation is one record of the output, so its turns
meet in one row whatever their number; contexts are made from it as an example is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
#: What every control string begins with, and how it is written inside a text. "&" comes first, as the others are written with it.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))


def escape(x: Column) -> Column:
    for plain, safe in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        x = F.replace(x, F.lit(safe), F.lit(plain))
    return x


def _role(x: Column) -> Column:
    """A role is written on one line."""
    return F.replace(escape(x), F.lit("\n"), F.lit("&nl;"))


def _unrole(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("&nl;"), F.lit("\n")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (head, body, trains), whose texts in order are the formatted conversation."""
    none = F.lit("")
    turn = F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return packed.select("conv_id", F.transform("t", lambda x: F.struct(
        F.concat(F.lit(HEAD), _role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("trains"))).alias("turns"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))), "")


def expand(formatted: DataFrame) -> DataFrame:
    """Examples: conv_id, pos, context, target (the text under the loss mask), after.

    A last row per conversation, whose target is null, holds the turns after the last reply as context
    (all of them without one), so that the output has every turn.
    """
    each = formatted.select("conv_id", "turns", F.posexplode("turns").alias("pos", "x")).filter("x.trains")
    each = each.select("conv_id", "pos", F.concat(_joined(F.slice("turns", F.lit(1), F.col("pos"))), "x.head").alias("context"), F.col("x.body").alias("target"), F.lit(TAIL).alias("after"))
    last = F.coalesce(F.array_max(F.transform("turns", lambda x, i: F.when(x["trains"], i + 1))), F.lit(0))
    rest = formatted.select("conv_id", F.size("turns").alias("pos"), _joined(F.slice("turns", last + 1, F.size("turns"))).alias("context"), F.lit(None).cast("string").alias("target"), F.lit("").alias("after"))
    return each.unionByName(rest)


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), losses (the trained texts in order), formatted_chars, from the formatted strings alone.

    The turns are those of the last example, its context, target and what follows, and of the rest after it; a
    context that isn't what the last example begins with is an error.
    """
    is_reply = F.col("target").isNotNull()
    got = examples.groupBy("conv_id").agg(
        F.max_by(F.when(is_reply, F.concat("context", "target", "after")), F.when(is_reply, F.col("pos"))).alias("last"),
        F.max(F.when(~is_reply, F.col("context"))).alias("rest"),
        F.sort_array(F.collect_list(F.when(is_reply, F.struct("pos", "target", F.length("context").alias("n"), F.crc32(F.col("context").cast("binary")).alias("crc"))))).alias("x"),
    )
    got = got.withColumn("last", F.coalesce("last", F.lit("")))
    agree = F.forall("x", lambda e: F.crc32(F.substr(F.col("last"), F.lit(1), e["n"]).cast("binary")) == e["crc"])
    got = got.withColumn("whole", F.when(agree, F.concat("last", "rest")).otherwise(F.raise_error(F.lit("a context isn't a prefix of its conversation"))))
    parts = F.filter(F.split("whole", r"<\|im_end\|>\n", -1), lambda s: s != "")
    body = lambda s: F.substr(s, F.lit(len(HEAD) + 1))
    turns = F.transform(parts, lambda s: F.struct(_unrole(F.substring_index(body(s), "\n", 1)).alias("role"), unescape(F.substr(body(s), F.instr(body(s), "\n") + 1)).alias("text")))
    return got.select("conv_id", turns.alias("turns"), F.transform("x", lambda y: unescape(y["target"])).alias("losses"), F.length("whole").cast("long").alias("formatted_chars"))
