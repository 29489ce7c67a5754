"""Rule bitmask ledger: each rule is evaluated once per document and stored as a bit, with the
measurements it was made from; versioned policies are masks over those bits.

Only DataFrame functions are used. Defined results: a null or empty text has no words and no
lines, and fails the word-count rule; repeated rows each get a row; other columns pass
through, those named as what is made here are replaced.
Three-word windows are compared by a 64-bit hash within one document (at 20,000 words the odds of
a clash are below 1e-11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import BLANKS, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule -> predicate over the measurements, in SQL; a rule's place is its bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
}

#: Policy version -> rules it applies.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v3": tuple(RULES),
}
BASE = "v1"
CURRENT = "v3"


def mask(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and failed_bits (long), one bit a rule of RULES. docs needs a column text."""
    kept = [c for c in docs.columns if c not in _MADE]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.struct(*kept).alias("_in"), words(F.col("text")).alias("_w"), text.alias("_t"))  # so that no column of docs clashes with what is made
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.select(
        "_in", "_w", lines.alias("_l"), F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(0))).alias("_h"),
    )
    df = df.withColumns({
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    at = F.filter(F.transform("_s", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_p", F.sort_array(at))
    # A window covers three words, less what the window before it covers.
    cover = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long")))
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    # The id only keeps filters on the bits from being moved below, where they would repeat all of the above within one expression.
    return df.withColumn("failed_bits", F.when(F.monotonically_increasing_id() >= 0, bits.cast("long"))).select("_in.*", *_MADE)


_MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "failed_bits"]


def failed(policy: str):
    """Whether a document of the ledger fails a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    return led.withColumns({"base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(policy))})


def ablations(led: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents kept, those kept without that rule, and those that fail any or all of its rules.

    The ledger is first summed by its bits (at most 2 ** rules groups), so rules aren't evaluated again.
    """
    counts = led.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rows = [(p, r, mask(rules), mask([r])) for p, rules in POLICIES.items() for r in rules]
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in rows])).alias("x")
    hit = F.col("failed_bits").bitwiseAND(F.col("x.mask"))
    return counts.select("failed_bits", "n", cells).groupBy("x.policy", "x.rule").agg(
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not("x.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or(hit).alias("bits_seen"), F.bit_and(hit).alias("bits_in_all"),
    )


def keep_passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass the base rules and the policy, with their own columns."""
    rows = docs.select("text", F.struct(*docs.columns).alias("_doc"))  # so that no column of docs clashes with what is made
    return apply_policy(ledger(rows), policy).filter("kept").select("_doc.*")
