"""Dataset, length, class-balance and run statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.sources.io import discard, saved


def moments(df: DataFrame, column: str, *by: str, sample: bool = False) -> DataFrame:
    """n, mean, std, lo, hi, total of a column. std: population, or of a sample (0 for one row)."""
    std = F.coalesce(F.stddev_samp(column), F.lit(0.0)) if sample else F.stddev_pop(column)
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), std.alias("std"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum(column).alias("total"))


def three_sigma(df: DataFrame, column: str) -> DataFrame:
    """mean, std (sample), low, high, covered: the share within three deviations."""
    m = df.agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std")).withColumns({"low": F.col("mean") - 3 * F.col("std"), "high": F.col("mean") + 3 * F.col("std")})
    x = df.select(column).crossJoin(F.broadcast(m))  # one row
    return x.groupBy("mean", "std", "low", "high").agg(F.avg(F.col(column).between(F.col("low"), F.col("high")).cast("double")).alias("covered"))


def length_bounds(df: DataFrame, column: str = "n") -> DataFrame:
    """u1, u2, u3: the mean and one to three population deviations, rounded up; c1 to c3: the share covered; recommended."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"), F.max(column).alias("hi")).select("hi", *[F.ceil(F.col("m") + k * F.col("s")).cast("long").alias(f"u{k}") for k in (1, 2, 3)])
    x = df.select(column).crossJoin(F.broadcast(m)).groupBy("hi", "u1", "u2", "u3").agg(*[F.avg((F.col(column) <= F.col(f"u{k}")).cast("double")).alias(f"c{k}") for k in (1, 2, 3)])
    return x.withColumn("recommended", F.when((F.col("u3") >= F.col("hi")) | (1 - F.col("c3") <= 0.001), F.col("u3")).otherwise(F.col("hi")))


#: Bins of a histogram, and the rows of a bin that are then looked at one by one.
BINS, FEW = 1024, 10_000


def order_statistics(df: DataFrame, column: str, ranks: DataFrame, *by: str, bins: int = BINS, few: int = FEW, rounds: list | None = None) -> DataFrame:
    """ranks (by, k: places from 0, of rows whose column isn't null) with value, the k-th least of its group.

    By repeated histograms: each round counts the rows of the ranges that still hold a wanted rank by bins, and goes on with the bins that hold it, cut to
    their least and largest value, until these are equal or a bin has few rows. So no task holds a group's values.
    rounds, where given, gets the number of ranks still open after each round.
    """
    group = [f"_g{k}" for k in range(len(by))]
    rows = df.filter(F.col(column).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, group)], F.col(column).cast("double").alias("v"))
    same = lambda a, b, names: F.lit(True) if not names else reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    ends = rows.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("size"))
    wanted = ranks.select(*[F.col(c).alias(g) for c, g in zip(by, group)], F.col("k").cast("long").alias("k")).distinct()
    open_ = saved(wanted.alias("w").join(ends.alias("e"), same("w", "e", group)).filter("k >= 0 and k < size").select(*[f"w.{g}" for g in group], "k", "lo", "hi", F.lit(0).cast("long").alias("below"), "size"), "ranks")
    done, old = [], []
    key = [*group, "lo", "hi"]
    inside = lambda iv: rows.alias("r").join(iv.alias("i"), same("r", "i", group) & F.col("v").between(F.col("lo"), F.col("hi"))).select(*[f"r.{g}" for g in group], "lo", "hi", "v")
    while True:
        done.append(open_.filter("lo = hi").select(*group, "k", F.col("lo").alias("value")))
        left = open_.filter("lo < hi and size > %d" % few)
        n = left.count()
        if rounds is not None:
            rounds.append(n)
        small = open_.filter("lo < hi and size <= %d" % few)
        each = inside(small.select(*key).distinct()).groupBy(*key, "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy(*key).orderBy("v"))
        each = each.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("c"))
        at = (F.col("k") - F.col("below") >= F.col("_from")) & (F.col("k") - F.col("below") < F.col("_to"))
        done.append(small.alias("s").join(each.alias("x"), same("s", "x", key) & at).select(*[f"s.{g}" for g in group], "k", F.col("v").alias("value")))
        if not n:
            break
        width = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
        h = inside(left.select(*key).distinct()).groupBy(*key, width.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        h = h.withColumn("_to", F.sum("c").over(W.partitionBy(*key).orderBy("bin"))).withColumn("_from", F.col("_to") - F.col("c"))
        old.append(open_)
        open_ = saved(left.alias("s").join(h.alias("x"), same("s", "x", key) & at).select(*[f"s.{g}" for g in group], "k", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_from")).alias("below"), F.col("c").alias("size")), "ranks")
    out = saved(reduce(DataFrame.unionByName, done), "values")
    discard(open_, *old)
    return out.select(*[F.col(g).alias(c) for c, g in zip(by, group)], "k", "value")


def quantiles(df: DataFrame, column: str, *by: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), names: tuple[str, ...] = ("p50", "p90", "p95", "p99"), **how) -> DataFrame:
    """by, and quantiles of a column with linear interpolation, exact; null for a group without values."""
    n = df.groupBy(*by).agg(F.count(column).alias("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("p")) for q, name in zip(at, names)])
    p = saved(n.select(*by, "n", F.explode(places).alias("x")).select(*by, "n", "x.*"), "places")
    ranks = p.select(*by, F.explode(F.array(F.floor("p"), F.ceil("p"))).alias("k"))
    found = order_statistics(df, column, ranks, *by, **how)
    on = lambda a, b, k: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.col(f"{b}.k") == k)
    both = p.alias("p").join(found.alias("a"), on("p", "a", F.floor("p.p")), "left").join(found.alias("b"), on("p", "b", F.ceil("p.p")), "left")
    value = F.col("a.value") + (F.col("p.p") - F.floor("p.p")) * (F.col("b.value") - F.col("a.value"))
    return both.groupBy(*[F.col(f"p.{c}").alias(c) for c in by]).agg(*[F.max(F.when(F.col("p.name") == name, value)).alias(name) for name in names])


def class_counts(df: DataFrame, label: str, classes: int, *by: str) -> DataFrame:
    """by, label, cnt, share, with zeros for the classes that are absent."""
    every = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = every.withColumn(label, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    c = every.join(df.groupBy(*by, label).agg(F.count("*").alias("cnt")), [*by, label], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return c.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy(*by)))


def balance(counts: DataFrame, *by: str) -> DataFrame:
    """Of class counts: entropy_norm, gini_impurity_norm, imbalance (infinite with an empty class), cv, kl to uniform, flagged, gini_equality."""
    k = F.count("*")
    p = F.greatest(F.col("share"), F.lit(1e-12))
    g = counts.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("cnt"))).groupBy(*by).agg(
        k.alias("classes"), (-F.sum(p * F.log(p)) / F.log(k)).alias("entropy_norm"), ((1 - F.sum(F.col("share") ** 2)) / (1 - 1 / k)).alias("gini_impurity_norm"),
        F.when(F.min("cnt") == 0, F.lit(float("inf"))).otherwise(F.max("cnt") / F.min("cnt")).alias("imbalance"), (F.stddev_pop("cnt") / F.avg("cnt")).alias("cv"),
        F.sum(F.when(F.col("share") > 0, F.col("share") * F.log(F.col("share")))).alias("_plogp"), (1 - (F.sum((2 * F.col("_r")) * F.col("cnt")) / (k * F.sum("cnt")) - (k + 1) / k)).alias("gini_equality"))
    g = g.withColumn("kl", F.col("_plogp") + F.log("classes")).drop("_plogp")
    return g.withColumn("flagged", ((F.col("imbalance") >= 1.5) & (F.col("imbalance") < float("inf"))) | (F.col("cv") >= 0.2) | (F.col("entropy_norm") <= 0.98))


def class_weights(counts: DataFrame) -> DataFrame:
    """label weights N / (K n), 1 for empty classes."""
    w = W.partitionBy()
    return counts.withColumn("weight", F.when(F.col("cnt") == 0, 1.0).otherwise(F.sum("cnt").over(w) / (F.count("*").over(w) * F.col("cnt"))))


def positives(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """by, label, cnt, n: positives by place of a 0/1 vector."""
    x = df.select(*by, F.posexplode(vector).alias("label", "v"))
    return x.groupBy(*by, "label").agg(F.sum("v").cast("long").alias("cnt"), F.count("*").alias("n"))


def run_statistics(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, std and var (sample, 0 for one run), lo, hi, median, n."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.median(value).alias("median"), F.count(value).alias("n"))


def fair_best(runs: DataFrame, a: str = "avg", b: str = "learned", maximise: str = "maximise"):
    """runs with fair: the better of two results by the task's direction; the other if one is missing."""
    return runs.withColumn("fair", F.when(F.col(maximise), F.greatest(a, b)).otherwise(F.least(a, b)))


def first_runs(runs: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first by order."""
    return runs.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


#: Metrics that an optimiser looks for, in this order, and those of which more is better.
TARGETS = ("mae", "rmse", "roc_auc", "ap", "accuracy", "f1", "precision", "recall")
MORE_IS_BETTER = ("accuracy", "roc_auc", "ap", "f1", "precision", "recall")


def objective(df: DataFrame, metrics: str = "metrics", fallback: str = "best_val_loss") -> DataFrame:
    """df with metric_name, objective, to be minimised: the first metric present of TARGETS, else the first other by name, else the fallback; negated if more is better.

    A row without any of them is an error.
    """
    m = F.col(metrics)
    there = F.map_filter(m, lambda k, v: v.isNotNull())
    others = F.array_sort(F.map_keys(there))
    name = F.coalesce(*[F.when(F.try_element_at(m, F.lit(t)).isNotNull(), F.lit(t)) for t in TARGETS], F.get(others, F.lit(0)), F.when(F.col(fallback).isNotNull(), F.lit(fallback)))
    value = F.coalesce(F.try_element_at(m, F.col("metric_name")), F.col(fallback))
    signed = F.when(F.col("metric_name").isin(*MORE_IS_BETTER), -value).otherwise(value)
    return df.withColumn("metric_name", name).withColumn("objective", F.when(F.col("metric_name").isNull(), F.raise_error(F.lit("no metric to optimise by")).cast("double")).otherwise(signed))


def label_kind(df: DataFrame, column: str) -> DataFrame:
    """label, kind, targets: what a label column is to predict, by its type: properties, several labels, several targets, a class, or a number; targets are members of the first row, or classes."""
    kind = df.schema[column].dataType.simpleString()
    whole = ("tinyint", "smallint", "int", "bigint")
    members = F.size(F.first(column, ignorenulls=True))
    name, count = (
        ("multi_property_regression", members) if kind.startswith("map") else ("multi_property_regression", F.lit(len(df.schema[column].dataType.names))) if kind.startswith("struct")
        else ("multi_label_classification", members) if kind in [f"array<{w}>" for w in whole] else ("multi_target_regression", members) if kind.startswith("array")
        else ("classification", F.countDistinct(column)) if kind in whole else ("regression", F.lit(1)) if kind in ("float", "double") or kind.startswith("decimal") else ("unknown", F.lit(None))
    )
    return df.agg(count.cast("long").alias("targets")).select(F.lit(column).alias("label"), F.lit(name).alias("kind"), "targets")


def file_size(df: DataFrame) -> DataFrame:
    """files, mib of the files that a scan reads."""
    each = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return each.agg(F.count("*").alias("files"), (F.sum("n") / (1 << 20)).alias("mib"))


#: What is gathered of runs.
VAL = ("val_loss", "accuracy", "precision", "recall", "f1", "roc_auc", "ap", "mae", "rmse", "r2")
TEST = {True: ("val_loss", "accuracy", "precision", "recall", "f1", "roc_auc", "ap", "pk"), False: ("val_loss", "mae", "rmse", "r2", "pk")}
MODES, TIME, TRAIN = ("avg", "best", "learned"), ("total_train_time_sec", "avg_epoch_time_sec"), ("last_loss", "learning_rate_last")


def rolled_up(runs: DataFrame, *by: str) -> DataFrame:
    """by, section, mode, metric, and run_statistics of runs: val (a map), test (maps by mode), time, train (maps), task.

    Of the test metrics those of the task are taken, and pk; a metric that no run has gives no row. Modes are "" but for test.
    """
    pick = lambda section, mode, m, names: F.transform(F.array(*map(F.lit, names)), lambda k: F.struct(F.lit(section).alias("section"), F.lit(mode).alias("mode"), k.alias("metric"), F.try_element_at(m, k).alias("value")))
    of_task = lambda mode: F.when(F.col("task").contains("classification"), pick("test", mode, F.try_element_at("test", F.lit(mode)), TEST[True])).otherwise(pick("test", mode, F.try_element_at("test", F.lit(mode)), TEST[False]))
    cells = F.concat(pick("val", "", F.col("val"), VAL), *[of_task(m) for m in MODES], pick("time", "", F.col("time"), TIME), pick("train", "", F.col("train"), TRAIN))
    rows = runs.select(*by, F.explode(cells).alias("x")).select(*by, "x.*").filter("value is not null")
    return run_statistics(rows, "value", *by, "section", "mode", "metric")


def pk_summary(rolled: DataFrame, *by: str) -> DataFrame:
    """by, mode, mean, std of the test's pk, of what rolled_up gives."""
    return rolled.filter("section = 'test' and metric = 'pk'").select(*by, "mode", "mean", "std")


def pivoted(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A table of mean values: a row a value of row, a column a value of column."""
    return rows.groupBy(row).pivot(column, columns).agg(F.avg(value))


def with_overall(df: DataFrame, by: str, *aggregates) -> DataFrame:
    """Aggregates for each value of by and, under "overall", for all."""
    return df.rollup(by).agg(F.grouping(by).alias("_all"), *aggregates).withColumn(by, F.when(F.col("_all") == 1, "overall").otherwise(F.col(by))).drop("_all")


def tasks(**choices: DataFrame) -> DataFrame:
    """A row each combination of the distinct values of short lists, each a table of one column, with task_id in their order."""
    out = None
    for name, values in choices.items():
        x = values.select(F.col(values.columns[0]).alias(name)).distinct()
        x = x.agg(F.sort_array(F.collect_list(name)).alias("_l"))  # one row
        out = x.select(F.posexplode("_l").alias("_i", name)).select(F.col("_i").cast("long").alias("task_id"), name) if out is None else (
            out.crossJoin(F.broadcast(x)).select("*", F.posexplode("_l").alias("_i", name)).withColumn("task_id", F.col("task_id") * F.size("_l") + F.col("_i")).drop("_i", "_l"))
    return out


def unpivoted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def efficiency(df: DataFrame, *by: str) -> DataFrame:
    """graphs, sequences, before, after, compression, graphs_per_s, tokens_per_s of rows (graph_id, n_before, n_after, seconds: of serializing the row)."""
    x = df.groupBy(*by).agg(F.countDistinct("graph_id").alias("graphs"), F.count("*").alias("sequences"), F.sum("n_before").alias("before"), F.sum("n_after").alias("after"), F.sum("seconds").alias("seconds"))
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds"))
    return x.withColumns({"compression": F.col("after") / F.col("before"), "graphs_per_s": rate("graphs"), "tokens_per_s": rate("before")})
