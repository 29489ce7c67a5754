"""Splits and samples of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATIOS = (0.8, 0.1)


def _named(k: Column, n: Column, ratios=RATIOS) -> Column:
    a, b = F.floor(n * ratios[0] + 1e-9), F.floor(n * (ratios[0] + ratios[1]) + 1e-9)
    return F.when(k < a, "train").when(k < b, "val").otherwise("test")


def buckets(rows: DataFrame, key: Column) -> Column:
    """The number of each row's range of a numeric key, null and least first. Bounds are fixed numbers from approximate quantiles, so a row is in the same range each time it is read."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(key.cast("double"), [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]).cast("array<double>")
    return F.size(F.filter(cuts, lambda b: b < key.cast("double")))


def placed(rows: DataFrame, *order, by: str | None = None, ratios=RATIOS) -> DataFrame:
    """rows with split by place in an order (its first column numeric), within each value of by if given.

    Places are taken within ranges of the order, so no task sees all rows, nor all of a value: a row's place is its place among its value's rows in its range, and their count in the ranges before.
    """
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    own = [by] if by else []
    spread = rows.withColumn("_p", buckets(rows, first))
    counts = spread.groupBy(*own, "_p").agg(F.count("*").alias("c"))  # a row a value and range
    earlier = W.partitionBy(*own).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias("_by") for c in own], F.col("_p").alias("_q"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("_b"), F.sum("c").over(W.partitionBy(*own)).alias("_n"))
    place = F.row_number().over(W.partitionBy(*own, "_p").orderBy(*order)) - 1
    on = F.col("_p") == F.col("_q")
    out = spread.withColumn("_i", place).join(before, on & F.col(by).eqNullSafe(F.col("_by")) if by else on)
    return out.withColumn("split", _named(F.col("_b") + F.col("_i"), F.col("_n"), ratios)).drop("_p", "_q", "_i", "_b", "_n", "_by")


def given(rows: DataFrame, parts: dict[str, DataFrame], key: str = "graph_id") -> DataFrame:
    """rows with split, of parts that are given: split -> ids. A row in none has no split; faults() tells of ids in several."""
    every = None
    for name, ids in parts.items():
        part = ids.select(F.col(ids.columns[0]).alias(key), F.lit("val" if name == "valid" else name).alias("split"))
        every = part if every is None else every.union(part)
    return rows.join(every, key, "left")


def arithmetic_key(column: str, seed: int = 42) -> Column:
    """A fixed shuffle of ids that SQL can repeat."""
    return (F.col(column) * 7919 + seed * 104729) % 1000003


def stratified(rows: DataFrame, label: str, key: str = "graph_id", seed: int = 42) -> DataFrame:
    return placed(rows, arithmetic_key(key, seed), key, by=label)


def shuffled(rows: DataFrame, key: str = "graph_id", seed: int = 42) -> DataFrame:
    return placed(rows, arithmetic_key(key, seed), key)


def drawn(rows: DataFrame, n: int, key: str = "graph_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, with new_id from 0 in order of key: the list to replay a subset with semi_join."""
    x = rows.orderBy(arithmetic_key(key, seed), key).limit(n)
    return x.withColumn("new_id", (F.row_number().over(W.orderBy(key)) - 1).cast("long"))  # n rows


def replayed(rows: DataFrame, chosen: DataFrame, key: str = "graph_id") -> DataFrame:
    return rows.join(chosen.select(key), key, "left_semi")


def faults(splits: DataFrame, graphs: DataFrame) -> DataFrame:
    """rows, twice (ids in more than one split or row), unknown (ids that aren't graphs)."""
    twice = splits.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("twice"))
    unknown = splits.join(graphs.select("graph_id"), "graph_id", "left_anti").agg(F.count("*").alias("unknown"))
    return twice.crossJoin(unknown)  # one row each


def of_split(sequences: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return sequences.join(splits.filter(F.col("split") == split).select("graph_id"), "graph_id", "left_semi")
