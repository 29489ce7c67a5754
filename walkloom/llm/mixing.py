"""Mixing sources to target weights: tokens are summed by source, repetition rates derived, and each
document is emitted floor(rate) times, plus once more if its hashed draw is below the fraction.

Only DataFrame functions are used. Defined results: null text has size 0 and is taken floor(rate)
times or once more like any other; a null source is a source, sorted last; a null doc_id draws as
empty text; repeated rows draw alike; other columns pass through, those named as what is made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.llm.common import materialize, words

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from (source, size). One row a source, so the windows see as many rows as there are sources.

    Shares go by weight and stop at cap times a source's size; sources sorted by the share at which
    they stop give the water level at which all tokens are dealt out.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("_cap", F.col("source_size") * cap)
    order = W.orderBy((F.col("_cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    by = by.withColumns({"_k": F.row_number().over(order), "_total": F.sum("source_size").over(every)})
    by = by.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("_total") - F.col("_before")).cast("double") / F.col("_left").cast("double")
    by = by.withColumn("_level", level)
    fits = F.col("_level") * F.col("weight") <= F.col("_cap").cast("double")
    by = by.withColumn("_water", F.coalesce(F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_k"))).over(every), F.lit(0.0)))
    return by.select("source", "source_size", "weight", F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (size * copies). docs has doc_id, source, and text or else a size."""
    size = F.size(words(F.col("text"))).cast("long") if "text" in docs.columns else F.col("size")
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    # In one column, so that no column of docs clashes with what is made.
    rows = docs.select(F.struct(*keep).alias("_in"), "doc_id", "source", size.alias("size"))
    # Written first: Spark then knows the table's size, and broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    by = materialize(source_targets(rows.select("source", "size"), weights, cap), "sources").select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    out = rows.join(by, rows["source"].eqNullSafe(by["_source"])).withColumn("_rate", rate)
    out = out.withColumn("copies", F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0))
    return out.select("_in.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_doc"))  # so that no column of docs clashes with what is made
    out = mixed(rows, **how).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
