"""Quantiles, splits, rankings and schedules against plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.operators import bpe, metrics, splits, stats, vocab


@pytest.mark.parametrize("bins, few", [(4, 3), (1024, 10_000)])
def test_quantiles(spark, bins, few):
    """Groups of every shape: ties, one value, a hot group, values far apart, nulls only."""
    rng = random.Random(bins)
    groups = {"ties": [5.0] * 40 + [1.0, 9.0], "one": [3.0], "hot": [rng.gauss(0, 1) for _ in range(400)], "far": [10.0**k for k in range(-20, 20)] + [-(7.0**k) for k in range(20)], "whole": [float(rng.randrange(9)) for _ in range(77)], "none": [None, None], None: [1.0, 2.0, None, 4.0]}
    rows = [(g, v) for g, x in groups.items() for v in x]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    rounds = []
    got = {r["g"]: tuple(r)[1:] for r in stats.quantiles(df, "v", "g", bins=bins, few=few, rounds=rounds).collect()}
    for g, x in groups.items():
        x = [v for v in x if v is not None]
        assert got[g] == pytest.approx(tuple(np.percentile(x, [50, 90, 95, 99])), rel=1e-12) if x else got[g] == (None,) * 4
    assert rounds[-1] == 0 and (few > 400) == (len(rounds) == 1)
    alone = stats.quantiles(df.filter("g = 'hot'"), "v", bins=bins, few=few).first()
    assert tuple(alone) == pytest.approx(tuple(np.percentile(groups["hot"], [50, 90, 95, 99])), rel=1e-12)


def test_stratified(spark):
    """A label that holds most rows is split over ranges, and gives the split of its order."""
    rows = [(k, "a" if k % 7 else ("b" if k % 2 else None)) for k in range(900)]
    got = {r["graph_id"]: r["split"] for r in splits.stratified(spark.createDataFrame(rows, "graph_id long, label string"), "label").collect()}
    for label in ("a", "b", None):
        own = sorted((k for k, x in rows if x == label), key=lambda k: ((k * 7919 + 42 * 104729) % 1000003, k))
        a, b = math.floor(len(own) * 0.8 + 1e-9), math.floor(len(own) * 0.9 + 1e-9)
        assert [got[k] for k in own] == ["train"] * a + ["val"] * (b - a) + ["test"] * (len(own) - b)
    plan = splits.stratified(spark.createDataFrame(rows, "graph_id long, label string"), "label")._jdf.queryExecution().executedPlan().toString()
    assert "_p" in plan  # no window over a label alone


def auc(y, s):
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(s, y) for b, q in zip(s, y) if p and not q]
    return sum(pairs) / len(pairs)


def test_class_ranking(spark):
    rng = random.Random(3)
    y = [rng.randrange(3) for _ in range(60)]
    p = [[rng.randrange(5) / 5 for _ in range(3)] for _ in y]
    df = spark.createDataFrame(list(zip(y, p)), "y_true int, probs array<double>")
    assert metrics.class_ranking(df).first()["roc_auc"] == pytest.approx(np.mean([auc([t == k for t in y], [x[k] for x in p]) for k in range(3)]))
    two = spark.createDataFrame([(t % 2, x[:2]) for t, x in zip(y, p)], df.schema)
    assert metrics.class_ranking(two).first()["roc_auc"] == pytest.approx(auc([t % 2 for t in y], [x[1] for x in p]))
    gone = metrics.class_ranking(df.filter("y_true < 2")).first()
    assert gone["roc_auc"] is None and gone["ap"] > 0


def test_several_labels(spark):
    rows = [(1, 0, [1.0, 0.0], [0.9, 0.4]), (1, 1, [1.0, 0.0], [0.8, 0.1]), (1, 2, [1.0, 0.0], [0.8, 0.1]), (2, 0, [0.0, 1.0], [0.5, 0.5])]
    df = spark.createDataFrame(rows, "graph_id long, variant_id int, y_true array<double>, probs array<double>")
    best = {r["graph_id"]: r["probs"] for r in metrics.labels_by_graph(df, "best").collect()}
    assert best == {1: [0.8, 0.1], 2: [0.5, 0.5]}
    mean = {r["graph_id"]: r["probs"] for r in metrics.labels_by_graph(df).collect()}
    assert mean[1] == pytest.approx([2.5 / 3, 0.2])


def test_runs(spark):
    m = "map<string,double>"
    rows = [("x", "regression", {"mae": 1.0, "f1": 0.5}, {"avg": {"mae": 2.0, "accuracy": 0.9, "pk": 1.0}, "best": {"mae": 1.5}}, {"total_train_time_sec": 3.0}, {}), ("x", "regression", {"mae": 2.0}, {"avg": {"mae": 4.0, "pk": 3.0}}, {"total_train_time_sec": 5.0}, {"last_loss": 1.0}), ("x", "multi_label_classification", {}, {"learned": {"ap": 0.3, "mae": 9.0}}, {}, {})]
    df = spark.createDataFrame(rows, f"method string, task string, val {m}, test map<string,{m}>, time {m}, train {m}")
    got = {(r["section"], r["mode"], r["metric"]): (r["mean"], r["std"], r["n"]) for r in stats.rolled_up(df, "method").collect()}
    assert got == {("val", "", "mae"): (1.5, pytest.approx(0.5**0.5), 2), ("val", "", "f1"): (0.5, 0.0, 1), ("test", "avg", "mae"): (3.0, pytest.approx(2**0.5), 2), ("test", "avg", "pk"): (2.0, pytest.approx(2**0.5), 2), ("test", "best", "mae"): (1.5, 0.0, 1), ("test", "learned", "ap"): (0.3, 0.0, 1), ("time", "", "total_train_time_sec"): (4.0, pytest.approx(2**0.5), 2), ("train", "", "last_loss"): (1.0, 0.0, 1)}
    assert [(r["mode"], r["mean"]) for r in stats.pk_summary(stats.rolled_up(df, "method"), "method").collect()] == [("avg", 2.0)]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [round(value(metrics.schedule(k, 100, 10)), 9) for k in (0, 9, 10, 100, 200)] == [0.1, 1.0, 1.0, 0.01, 0.01] and value(metrics.schedule(0, 0, 0)) == 1.0
    assert value(metrics.bce_with_logits(F.lit(800.0), F.lit(0.0))) == 800.0 and value(metrics.bce_with_logits(F.lit(-800.0), F.lit(1.0))) == 800.0
    assert [value(bpe.eval_limit(F.lit(m), 50, 20, 1, 4)) for m in ("none", "all", "topk", "random", "triangular", "gaussian", "other")] == [0, 50, 20, 2, 2, 20, 50]
    assert value(bpe.eval_limit(F.lit("gaussian"), 50, None, 0, 30)) == 30 and value(bpe.eval_limit(F.lit("random"), 50, None, 2, 5)) == 4
    noise = [r[0] for r in spark.range(4000).select(metrics.noisy(F.lit(1.0), 0.5, "id")).collect()]
    assert abs(np.mean(noise) - 1) < 0.05 and abs(np.std(noise) - 0.5) < 0.05
    lengths = spark.createDataFrame([(3,), (5,), (100,)], "n long")
    assert vocab.length_policy(lengths, positions=102).first()[0] == 102 and vocab.length_policy(lengths, cap=50).first()[0] == 50 and vocab.length_policy(lengths.limit(0)).first()[0] == 2
    with pytest.raises(Exception, match="more than the 101 positions"):
        vocab.length_policy(lengths, positions=101).collect()


def test_masked_ids(spark):
    """Tokens put in place of others come from the whole vocabulary, special ones left out."""
    s = spark.createDataFrame([(k, list(range(8, 28)) * 40) for k in range(8)], "graph_id long, tokens array<int>")
    other = {x for r in vocab.masked(s, 5000).collect() for x in r["input_ids"]} - set(range(8, 28)) - {2}
    assert max(other) > 4000 and min(other) >= 8 and len(other) > 50


def test_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, [1, 0], [1.0], {"a": 1.0, "b": 2.0}, "t"), (0, 3.0, [1, 1], [2.0], {"a": 1.0, "b": 2.0}, "u")], "c int, r double, l array<int>, t array<double>, p map<string,double>, s string")
    got = {tuple(stats.label_kind(df, c).first()) for c in df.columns}
    assert got == {("c", "classification", 2), ("r", "regression", 1), ("l", "multi_label_classification", 2), ("t", "multi_target_regression", 1), ("p", "multi_property_regression", 2), ("s", "unknown", None)}


def test_file_size(spark, tmp_path):
    import os

    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t")
    want = sum(os.path.getsize(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    got = stats.file_size(spark.read.parquet(f"{tmp_path}/t")).first()
    assert got["files"] == 3 and got["mib"] * (1 << 20) == pytest.approx(want)


def test_masked_by_the_numbers_of_uniform(spark, monkeypatch):
    """Lists in one batch or several, keys of any size, and what is null, as by uniform() on each token."""
    monkeypatch.setattr(vocab, "DRAWN_AT_ONCE", 700)
    rows = [(g, [(7 * g + i) % 40 for i in range(n)]) for g, n in ((3, 900), (-5, 400), (0, 0), (9, 1), (123_456_789, 1500))]
    s = spark.createDataFrame([*rows, (None, [9, 3]), (4, None), (2**62, [20] * 60)], "graph_id long, tokens array<int>").coalesce(1)
    got = {r["graph_id"]: (r["input_ids"], r["labels"]) for r in vocab.masked(s, 48, p=0.4).collect()}
    assert got[None] == ([9, 3], [-100, -100]) and got[4] == (None, None) and 5 < sum(x == 20 for x in got[2**62][1]) < 55
    u = lambda what: vocab.uniform(f"{what}:42", "graph_id", F.col("i"))
    each = spark.createDataFrame(rows, "graph_id long, tokens array<int>").select("graph_id", F.posexplode("tokens").alias("i", "x")).select("graph_id", "i", "x", u("draw").alias("draw"), u("how").alias("how"), u("token").alias("token"))
    assert "transform" not in vocab.masked(s, 48)._jdf.queryExecution().executedPlan().toString()
    for r in each.collect():
        drawn = r["x"] >= 8 and r["draw"] < 0.4
        new = (2 if r["how"] < 0.8 else 8 + int(r["token"] * 40) if r["how"] < 0.9 else r["x"]) if drawn else r["x"]
        assert (got[r["graph_id"]][0][r["i"]], got[r["graph_id"]][1][r["i"]]) == (new, r["x"] if drawn else -100)
