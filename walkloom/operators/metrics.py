"""Evaluation metrics and aggregation of variants. Predictions: graph_id, variant_id, y_true, y_pred or probs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.operators.splits import buckets

#: The main metric of a task, and the tasks whose metric is to rise.
PRIMARY = {"mlm": "loss", "regression": "mae", "multi_target_regression": "mae", "binary_classification": "roc_auc", "classification": "accuracy", "multi_label_classification": "ap"}
RISING = ("binary_classification", "classification", "multi_label_classification")


def primary(task, dataset) -> tuple[Column, Column]:
    """Columns: the main metric of a task, and whether it is to rise. Unknown tasks go by loss; classification of molhiv by roc_auc."""
    task, dataset = F.col(task), F.col(dataset)
    known = F.create_map(*[F.lit(x) for kv in PRIMARY.items() for x in kv])
    special = (task == "classification") & F.coalesce(dataset == "molhiv", F.lit(False))
    return F.when(special, "roc_auc").otherwise(F.coalesce(F.try_element_at(known, task), F.lit("loss"))), F.coalesce(task.isin(*RISING), F.lit(False))


def by_graph(pred: DataFrame, how: str = "avg") -> DataFrame:
    """One regression result a graph: the mean, or the nearest (the first variant on ties; looks at the truth, so an upper bound)."""
    y = F.avg("y_pred") if how == "avg" else F.min_by("y_pred", F.struct(F.abs(F.col("y_pred") - F.col("y_true")), "variant_id"))
    return pred.groupBy("graph_id").agg(F.first("y_true").alias("y_true"), y.alias("y_pred"))


def mean_probs(pred: DataFrame) -> DataFrame:
    """graph_id, y_true, probs: element-wise means."""
    x = pred.select("graph_id", "y_true", F.posexplode("probs").alias("k", "p")).groupBy("graph_id", "k").agg(F.first("y_true").alias("y_true"), F.avg("p").alias("p"))
    return x.groupBy("graph_id").agg(F.first("y_true").alias("y_true"), F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("probs"))


def labels_by_graph(pred: DataFrame, how: str = "avg") -> DataFrame:
    """graph_id, y_true (array of 0 and 1), probs of several labels: element-wise means, or the variant nearest to the truth by mean absolute difference (the first on ties)."""
    if how == "avg":
        return mean_probs(pred)
    far = F.aggregate(F.zip_with("probs", "y_true", lambda p, y: F.abs(p - y)), F.lit(0.0), lambda a, x: a + x) / F.size("probs")
    return pred.groupBy("graph_id").agg(F.first("y_true").alias("y_true"), F.min_by("probs", F.struct(far.alias("d"), "variant_id")).alias("probs"))


def argmax(a) -> Column:
    """The place, from 0, of the first largest member."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def classes_by_graph(pred: DataFrame, how: str = "avg") -> DataFrame:
    """graph_id, y_true, y_pred: argmax of mean probabilities, or the truth if any variant hits it, else the commonest class (the least on ties)."""
    if how == "avg":
        return mean_probs(pred).select("graph_id", "y_true", argmax("probs").alias("y_pred"))
    votes = pred.select("graph_id", "y_true", argmax("probs").alias("c")).groupBy("graph_id", "y_true", "c").agg(F.count("*").alias("n"))
    return votes.groupBy("graph_id", "y_true").agg(F.coalesce(F.max(F.when(F.col("c") == F.col("y_true"), F.col("c"))), F.max_by("c", F.struct("n", -F.col("c")))).alias("y_pred"))


def weighted_mean(pred: DataFrame, score: str = "score") -> DataFrame:
    """graph_id, y_true, y_pred: variants weighed by the softmax of their scores."""
    e = F.exp(F.col(score) - F.max(score).over(W.partitionBy("graph_id")))
    x = pred.withColumn("_e", e)
    return x.groupBy("graph_id").agg(F.first("y_true").alias("y_true"), (F.sum(F.col("_e") * F.col("y_pred")) / F.sum("_e")).alias("y_pred"))


def variant_sets(pred: DataFrame) -> DataFrame:
    """graph_id, preds (padded with 0 to the most variants of a graph), mask."""
    g = pred.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant_id", "y_pred"))), lambda s: s["y_pred"]).alias("p"))
    most = pred.groupBy("graph_id").agg(F.count("*").cast("int").alias("n")).agg(F.max("n").alias("k"))
    g, n, k = g.crossJoin(F.broadcast(most)), F.size("p"), F.col("k")
    return g.select("graph_id", F.concat("p", F.array_repeat(F.lit(0.0), k - n)).alias("preds"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), k - n)).alias("mask"))


def regression(df: DataFrame, *by: str) -> DataFrame:
    """n, mse, mae, rmse, r2, corr of y_true, y_pred."""
    e = F.col("y_true") - F.col("y_pred")
    x = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y_true").alias("_v"), F.corr("y_true", "y_pred").alias("corr"))
    return x.withColumns({"rmse": F.sqrt("mse"), "r2": F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(0.0), "corr": F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0))}).drop("_v")


def classification(df: DataFrame) -> DataFrame:
    """n, accuracy, macro precision, recall and f1 over the classes that occur, 0 where undefined. Counts are one row a class."""
    c = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.lit(0).alias("side")), F.struct(F.col("y_pred").alias("c"), F.lit(1).alias("side")))).alias("x"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit")).select("x.*", "n", "hit")
    per = both.groupBy("c").agg(*[F.sum(F.when(e, F.col("n")).otherwise(0)).alias(a) for a, e in (("t", F.col("side") == 0), ("p", F.col("side") == 1), ("tp", (F.col("side") == 0) & F.col("hit")))])
    pr, rc = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    per = per.withColumns({"pr": pr, "rc": rc}).withColumn("f1", F.when(F.col("pr") + F.col("rc") > 0, 2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))).otherwise(0.0))
    return per.agg(F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg("pr").alias("precision"), F.avg("rc").alias("recall"), F.avg("f1").alias("f1"))


def ranking(df: DataFrame, *by: str) -> DataFrame:
    """roc_auc and ap of y (0 or 1) by score; ties share their rank. Rows are first summed by distinct score.

    Scores are dealt by ranges, and sums within a range are added to those of the ranges below it, so no task sees all scores.
    """
    g = df.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    g = g.withColumn("_p", buckets(g, F.col("score")))
    own = W.partitionBy("_p", *by).orderBy("score")
    g = g.withColumns({"_pos": F.sum("pos").over(own), "_n": F.sum("n").over(own)})
    parts = g.groupBy("_p", *by).agg(F.max("_pos").alias("a"), F.max("_n").alias("b"))  # a row a range
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    parts = parts.select("_p", *[F.col(c).alias(f"_{c}") for c in by], zero(F.sum("a").over(before)).alias("_a"), zero(F.sum("b").over(before)).alias("_b"), F.sum("a").over(W.partitionBy(*by)).alias("_t"), F.sum("b").over(W.partitionBy(*by)).alias("_all"))
    on = g["_p"] == parts["_p"]
    for c in by:
        on &= g[c].eqNullSafe(parts[f"_{c}"])
    x = g.join(F.broadcast(parts), on).withColumns({"_pos": F.col("_pos") + F.col("_a"), "_n": F.col("_n") + F.col("_b")})
    below = F.col("_n") - F.col("_pos") - (F.col("n") - F.col("pos"))
    tp, seen = F.col("_t") - F.col("_pos") + F.col("pos"), F.col("_all") - F.col("_n") + F.col("n")
    x = x.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)).alias("u"), F.sum(F.col("pos") * tp / seen).alias("s"))
    neg = F.col("n") - F.col("pos")
    return x.select(*by, F.when((F.col("pos") > 0) & (neg > 0), F.col("u") / (F.col("pos") * neg)).alias("roc_auc"), F.when(F.col("pos") > 0, F.col("s") / F.col("pos")).alias("ap"))


def one_vs_rest(pred: DataFrame) -> DataFrame:
    """y, score by label k, of y_true and probs."""
    return pred.select(F.posexplode("probs").alias("k", "score"), "y_true").select("k", "score", (F.col("y_true") == F.col("k")).cast("int").alias("y"))


def class_ranking(pred: DataFrame) -> DataFrame:
    """roc_auc and ap of y_true and probs: of two classes, by the second's probability; of more, means over each class against the rest. A class that doesn't occur has no area, so the mean has none, and an ap of 0."""
    width = F.size("probs")
    two = ranking(pred.filter(width == 2).select((F.col("y_true") == 1).cast("int").alias("y"), F.col("probs")[1].alias("score")))
    per = ranking(one_vs_rest(pred.filter(width > 2)), "k")
    more = per.agg(F.when(F.count("roc_auc") == F.count("*"), F.avg("roc_auc")).alias("roc_auc"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"))
    return two.filter("ap is not null").union(more.filter("ap is not null"))


def multi_label(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ap (macro, 0 where undefined), precision, recall, f1 (macro), hamming accuracy of rows (k, y, score)."""
    ap = ranking(rows, "k").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"))
    p = (F.col("score") > threshold).cast("int")
    per = rows.groupBy("k").agg(F.sum(p * F.col("y")).alias("tp"), F.sum(p).alias("p"), F.sum("y").alias("t"), F.avg((p == F.col("y")).cast("double")).alias("h"))
    pr, rc = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    f1 = F.when(F.col("p") + F.col("t") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t"))).otherwise(0.0)
    return per.agg(F.avg(pr).alias("precision"), F.avg(rc).alias("recall"), F.avg(f1).alias("f1"), F.avg("h").alias("hamming")).crossJoin(ap)  # one row each


def multi_target(rows: DataFrame) -> DataFrame:
    """mae, mse, rmse (of the mean mse), r2, corr: means over targets of rows (k, y_true, y_pred)."""
    return regression(rows, "k").agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"), F.avg("r2").alias("r2"), F.avg("corr").alias("corr"))


def softmax(logits) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-(F.col(x) if isinstance(x, str) else x)))


def perplexity(df: DataFrame, nll: str = "nll", label: str = "label") -> DataFrame:
    """exp of the mean loss where the label isn't -100; infinite if there is none."""
    return df.agg(F.coalesce(F.exp(F.avg(F.when(F.col(label) != -100, F.col(nll)))), F.lit(float("inf"))).alias("perplexity"))


def pooled(rows: DataFrame) -> DataFrame:
    """graph_id, k, mean, cls of rows (graph_id, pos, mask, vec): the mean where mask is 1, and the first."""
    x = rows.select("graph_id", "pos", "mask", F.posexplode("vec").alias("k", "v"))
    return x.groupBy("graph_id", "k").agg(F.avg(F.when(F.col("mask") == 1, F.col("v"))).alias("mean"), F.min_by("v", "pos").alias("cls"))


def stopped(log: DataFrame, patience: int, maximise: bool = True) -> DataFrame:
    """run_id, best, best_epoch, stop_epoch (null if never) of rows (run_id, epoch, value): it stops when patience epochs bring nothing better."""
    v = F.col("value") if maximise else -F.col("value")
    w = W.partitionBy("run_id").orderBy("epoch")
    x = log.withColumn("_v", v).withColumn("_best", F.max("_v").over(w.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("_at", F.max(F.when(F.col("_best").isNull() | (F.col("_v") > F.col("_best")), F.col("epoch"))).over(w))
    x = x.withColumn("_stop", F.when(F.col("epoch") - F.col("_at") >= patience, F.col("epoch")))
    x = x.withColumn("_end", F.min("_stop").over(W.partitionBy("run_id"))).filter(F.col("_end").isNull() | (F.col("epoch") <= F.col("_end")))
    return x.groupBy("run_id").agg(F.max_by("value", F.struct("_v", -F.col("epoch"))).alias("best"), F.max_by("epoch", F.struct("_v", -F.col("epoch"))).cast("long").alias("best_epoch"), F.max("_end").cast("long").alias("stop_epoch"))


def losses(df: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """df (y 0 or 1, p) with cross entropy, that weighted by class, focal loss (gamma 2), squared and absolute error."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    w = F.when(F.col("y") == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    return df.withColumns({"ce": -F.log(pt), "weighted_ce": -w * F.log(pt), "focal": -F.pow(1 - pt, F.lit(2.0)) * F.log(pt), "l2": F.pow(F.col("y") - F.col("p"), F.lit(2.0)), "l1": F.abs(F.col("y") - F.col("p"))})


def bce_with_logits(x, y) -> Column:
    """Binary cross entropy of a logit, in the form that doesn't overflow."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def noisy(x, sigma: float, *keys, seed: int = 42) -> Column:
    """x with Gaussian noise, drawn by a digest of the keys: the same for the same keys."""
    from walkloom.operators.bpe import draw

    normal = F.sqrt(-2 * F.log(F.greatest(draw(f"{seed}:a", *keys), F.lit(1e-12)))) * F.cos(2 * F.pi() * draw(f"{seed}:b", *keys))
    return (F.col(x) if isinstance(x, str) else x) + normal * sigma


def two_way_kl(a, b) -> Column:
    """The mean of both Kullback-Leibler divergences of two arrays of probabilities."""
    x = F.zip_with(a, b, lambda p, q: (p - q) * (F.log(p) - F.log(q)))
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / 2


def mixup(a, b, share) -> Column:
    """Two arrays mixed member by member."""
    return F.zip_with(a, b, lambda x, y: x * share + y * (1 - share))


def schedule(step, steps, warm, floor: float = 0.01) -> Column:
    """The factor of a learning rate at a step: a linear rise over warm steps, then a cosine down to floor; 1 if there are no steps."""
    step, steps, warm = (F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c for c in (step, steps, warm))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0), step - warm) / F.greatest(F.lit(1), steps - warm))
    return F.when(steps <= 0, 1.0).when((warm > 0) & (step < warm), (step + 1) / warm).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * t)))
