from pyspark.sql import functions as F

from walkloom import streaming
from walkloom.functions import register
from walkloom.operators import bpe, metrics, stats, vocab
from walkloom.sources import importers, io


def test_balance_golden(spark):
    c = spark.createDataFrame([(0, 6, 0.6), (1, 3, 0.3), (2, 1, 0.1)], "label int, cnt long, share double")
    r = stats.balance(c).first()
    assert [round(r[k], 6) for k in ("entropy_norm", "gini_impurity_norm", "imbalance", "cv", "kl")] == [0.817345, 0.81, 6.0, 0.616441, 0.200667]


def test_ranking_golden(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.4), (1, 0.8)], "y int, score double")
    r = metrics.ranking(df).first()
    assert round(r["roc_auc"], 6) == 0.75 and round(r["ap"], 6) == 0.805556


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, [])], "graph_id long, tokens array<int>")
    io.write_sequences(f"{tmp_path}/s", df, "feuler", 4)
    io.write_sequences(f"{tmp_path}/s", df.limit(1), "bfs")
    assert io.same(io.read_sequences(spark, f"{tmp_path}/s", "feuler", 4), df)
    rules = bpe.train(df.union(df), 3)
    io.write_codebook(f"{tmp_path}/c.json", rules)
    assert io.same(io.read_codebook(spark, f"{tmp_path}/c.json"), rules)
    assert io.digest(df).first() == io.digest(df.orderBy(F.desc("graph_id")).select("tokens", "graph_id")).first()
    for split, ids in (("train", "[1, 2]"), ("val", "[3]"), ("test", "[]")):
        (tmp_path / f"{split}.json").write_text(ids)
    assert io.read_splits(spark, str(tmp_path)).count() == 3
    assert io.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_augmentation(spark):
    """Exact counts of places changed, by length; the same draw each time; short sequences stay."""
    rows = [(k, [100 + j for j in range(k)]) for k in range(30)]
    df = spark.createDataFrame(rows, "graph_id long, tokens array<int>")
    for how in ("deletion", "insertion", "replacement", "swap", "truncation", "masking"):
        new = lambda p, e=0: {r[0]: r[1] for r in vocab.augmented(df, how, 0.3, p, epoch=e, valid=(7, 8)).collect()}
        got = new(1.0)
        assert got == new(1.0) and new(0.0) == dict(rows) and got != new(1.0, 1)
        for k, t in got.items():
            n, was = int(k * 0.3 + 1e-9), [100 + j for j in range(k)]
            if how == "deletion":
                assert len(t) == k - (min(n, k - 1) if k > 1 else 0) and set(t) <= set(was) and t == sorted(t)
            if how == "insertion":
                assert len(t) == k + n and [x for x in t if x >= 100] == was
            if how == "replacement":
                assert len(t) == k and sum(x < 100 for x in t) == n and all(x in (7, 8) or x == y for x, y in zip(t, was))
            if how == "swap":
                assert sorted(t) == was and sum(x != y for x, y in zip(t, was)) <= 2 * n
            if how == "truncation":
                assert len(t) >= max(1, n) * (k > 0) and t == was[was.index(t[0]) :][: len(t)] if t else not was
            if how == "masking":
                assert len(t) == k and sum(x == 2 for x in t) == (max(1, min(n, k - 1)) if k > 1 else 0)
    half = sum(a != b for (_, a), b in zip(rows, (r[1] for r in vocab.augmented(df, "insertion", 0.5, 0.5, valid=(7,)).orderBy("graph_id").collect())))
    assert 5 < half < 25


def test_stream_is_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-01 00:{k % 60:02d}:00", k % 3, "view" if k % 2 else "click", 1.0) for k in range(100)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t").withColumn("props", F.lit("{}"))
    rows.write.parquet(f"{tmp_path}/in")
    s = streaming.read(spark, f"{tmp_path}/in", streaming.EVENTS)
    assert io.same(streaming.finished(streaming.counts(s, "event_type"), f"{tmp_path}/a"), streaming.counts(rows, "event_type"))
    assert io.same(streaming.finished(streaming.tumbling(s), f"{tmp_path}/b"), streaming.tumbling(rows))
    assert io.same(streaming.finished(streaming.sessions(s), f"{tmp_path}/c"), streaming.sessions(rows))


def test_graphs_round_trip(spark, tmp_path):
    """Graphs, vocabularies, metrics and splits come back as they were written; what is missing is told apart."""
    from walkloom.operators import graph
    from walkloom.sources import views

    edges = spark.createDataFrame([(1, 0, 0, 1, 5, 6, 1, 0.5), (1, 1, 1, 0, 6, 5, 1, 0.5), (1, 2, 1, 2, 6, 7, 2, 2.0), (1, 3, 2, 1, 7, 6, 2, 2.0), (2, 0, 0, 1, 5, 5, 1, 1.0), (2, 1, 1, 0, 5, 5, 1, 1.0)], "graph_id long, edge_id int, src int, dst int, src_type int, dst_type int, edge_type int, weight double")
    nodes = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 5), (2, 1, 5), (3, 0, 9), (3, 1, 9)], "graph_id long, node_id int, node_type int")
    io.write_graphs(f"{tmp_path}/g", nodes, edges)
    assert all(io.same(a, b) for a, b in zip(io.read_graphs(spark, f"{tmp_path}/g"), (nodes, edges)))
    packed = views.pack(nodes.filter("graph_id < 3"), edges)
    assert io.same(packed, views.packed_edges(edges))
    assert {(r["graph_id"], r["node_id"]): r["root"] for r in graph.spread_components(nodes, edges, io.saved).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (2, 0): 0, (2, 1): 0, (3, 0): 0, (3, 1): 1}
    assert {(r["graph_id"], r["node_id"]): (r["root"], r["rank"]) for r in graph.components(views.pack(nodes, edges)).collect()} == {(1, 0): (0, 0), (1, 1): (0, 0), (1, 2): (0, 0), (2, 0): (0, 0), (2, 1): (0, 0), (3, 0): (0, 0), (3, 1): (1, 1)}
    paths = spark.createDataFrame([(1, [0, 1, 2]), (1, [0, 2]), (2, [0, 1]), (2, [0, 1, 0]), (1, [1])], "graph_id long, path array<int>")
    assert {(r[0], tuple(r[1])): r[2] for r in graph.path_weight(paths, edges).collect()} == {(1, (0, 1, 2)): 2.5, (1, (0, 2)): float("inf"), (2, (0, 1)): 1.0, (2, (0, 1, 0)): 2.0, (1, (1,)): 0.0}
    assert {(r[0], tuple(r[1])): (r[2], r[3]) for r in graph.path_validity(paths, nodes, edges).collect()} == {(1, (0, 1, 2)): (True, False), (1, (0, 2)): (False, False), (2, (0, 1)): (True, True), (2, (0, 1, 0)): (False, True), (1, (1,)): (False, False)}
    (tmp_path / "m" / "deep").mkdir(parents=True)
    (tmp_path / "m" / "a.json").write_text('{"dataset": "zinc", "method": "bert", "test_metrics": {"mae": 0.123, "rmse": 0.456}, "best_val_loss": 0.789}')
    (tmp_path / "m" / "deep" / "b.json").write_text('{"dataset": "zinc", "test_metrics": {"accuracy": 0.88}}')
    (tmp_path / "m" / "deep" / "c.txt").write_text("{}")
    runs, skipped = io.read_metrics(spark, f"{tmp_path}/m")
    assert [(r["dataset"], r["metric_name"], r["objective"]) for r in stats.objective(runs.withColumnRenamed("test_metrics", "metrics")).collect()] == [("zinc", "mae", 0.123)]
    assert [r["reason"] for r in skipped.collect()] == ["method"]


def test_sql_functions(spark):
    register(spark, bpe.train(spark.createDataFrame([([1, 2, 1, 2],)], "tokens array<int>"), 1))
    assert spark.sql("select bpe_encode(array(1, 2, 1)) x").first()[0] == [4, 1]
    assert [r["token"] for r in spark.sql("select * from graph_walk(array(6, 6), array(0, 1), array(1, 0), array(1, 1), 'feuler')").collect()] == [13, 13, 13]


def test_whole_texts(spark, tmp_path):
    """Characters and types that occur only far into a text."""
    from collections import Counter
    from hashlib import md5

    from walkloom.plans import QUERIES

    texts = ["ab" * 40 + "z" * 60, "", "b" * 100 + "é\U0001f600" * 30, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    get = lambda q: QUERIES[q](spark, str(tmp_path))
    chars = {(d, k, ord(c)) for d, t in enumerate(texts) for k, c in enumerate(t)}
    count = Counter(c for t in texts for c in map(ord, t))
    digest = lambda xs: md5(" ".join(map(str, xs)).encode()).hexdigest()
    points = {d: (len(t), digest(map(ord, t))) for d, t in enumerate(texts) if t}
    assert {r["graph_id"]: (r["n"], r["points"]) for r in get("O-TK10").collect()} == points
    assert {r["graph_id"]: (r["n"], r["tokens"]) for r in get("O-SE8").collect()} == points
    assert {r["tok"]: r["cnt"] for r in get("O-VO1").collect()} == count
    first = {c: min((d, k) for d, k, x in chars if x == c) for c in count}
    ids = {c: k + 8 for k, c in enumerate(sorted(count, key=lambda c: (-count[c], first[c])))}
    assert {tuple(r) for r in get("O-VO2").collect()} == {(c, ids[c], n) for c, n in count.items()}
    common = {c: i for c, i in ids.items() if count[c] >= 50}
    assert {r["graph_id"]: r["ids"] for r in get("O-VO4").collect()} == {d: digest(common.get(ord(c), 1) for c in t) for d, t in enumerate(texts) if t}
    body = {d: [3, *[ids[ord(c)] for c in t][:46], 4] for d, t in enumerate(texts) if t}
    assert {r["graph_id"]: (r["input_ids"], r["used"]) for r in get("O-VO5").collect()} == {d: (",".join(map(str, b + [0] * (48 - len(b)))), len(b)) for d, b in body.items()}
    r = get("O-VO6").first()
    assert (r["types"], r["unknown"]) == (len(count), len(count) - len(common))
    assert {r["graph_id"] for r in get("O-VO8").collect()} == set(points)
    zz = [r for r in get("O-BP16_texts").collect() if (r["left"], r["right"]) == (ord("z"), ord("z"))]
    assert zz and zz[0]["cnt"] == 59


def test_variant_sets_keep_all(spark):
    df = spark.createDataFrame([(g, v, float(10 * g + v)) for g, n in ((1, 7), (2, 3)) for v in range(n)], "graph_id long, variant_id int, y_pred double")
    got = {r["graph_id"]: (r["preds"], r["mask"]) for r in metrics.variant_sets(df).collect()}
    assert got == {1: ([10.0 + v for v in range(7)], [1] * 7), 2: ([20.0, 21.0, 22.0] + [0.0] * 4, [1] * 3 + [0] * 4)}
    assert metrics.variant_sets(df.limit(0)).count() == 0


def test_numbered_lines(spark, tmp_path):
    """Files in several splits each: lines keep their places, empty ones too."""
    texts = [[f"{k} " + "x" * (k * 7 % 40) if k % 5 else "" for k in range(f, f + 400)] for f in (0, 1000)]
    for i, own in enumerate(texts):
        (tmp_path / f"part-{i}.txt").write_text("\n".join(own) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "900")
    try:
        got = sorted(map(tuple, importers.numbered(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == list(enumerate(texts[0] + texts[1]))


def test_read_tu(spark, tmp_path):
    files = {"A": "1, 2\n2, 1\n4, 5\n5, 3\n", "graph_indicator": "1\n1\n2\n2\n2\n", "graph_labels": "1\n-1\n", "node_labels": "7\n8\n9\n7\n8\n"}
    for name, text in files.items():
        (tmp_path / f"T_{name}.txt").write_text(text)
    graphs, nodes, edges = importers.read_tu(spark, str(tmp_path), "T", edge_labels=False)
    assert sorted(map(tuple, graphs.collect())) == [(0, 1), (1, -1)]
    assert sorted(map(tuple, nodes.collect())) == [(0, 0, 7), (0, 1, 8), (1, 0, 9), (1, 1, 7), (1, 2, 8)]
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 0, 1, 0), (0, 1, 1, 0, 0), (1, 0, 1, 2, 0), (1, 1, 2, 0, 0)]


def test_weights_of_equal_paths(spark):
    """Each row of paths has its own weight, also where paths are equal, and no step carries its path."""
    from walkloom.operators import graph

    edges = spark.createDataFrame([(1, 0, 1, 1.5), (1, 1, 2, 1.0)], "graph_id long, src int, dst int, weight double")
    got = graph.path_weight(spark.createDataFrame([(1, [0, 1, 2]), (1, [0, 1, 2]), (1, []), (1, [2, 1])], "graph_id long, path array<int>"), edges)
    assert sorted((tuple(r[1]), r[2]) for r in got.collect()) == [((), 0.0), ((0, 1, 2), 2.5), ((0, 1, 2), 2.5), ((2, 1), float("inf"))]


def test_owners_of_lines_are_not_broadcast(spark):
    """The lines of a data set in counted files are joined to their graphs by sorting: they are many more than Spark estimates."""
    from walkloom.plans import QUERIES

    plan = QUERIES["O-SC9_counted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [line") == 3


def test_rows_of_a_task(spark, monkeypatch):
    """What is done by graph is dealt to as many tasks as the rows need, whatever Spark's number of partitions."""
    from walkloom.sources import views

    monkeypatch.setattr(views, "TASK_ROWS", 500)
    rows = views.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert views.edges(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 500) > 4


def test_own_target(spark):
    """Rows that differ in their properties each give their own: the one named, the default, the only one, or an error."""
    import pytest

    df = spark.createDataFrame([(1, {"price": 5.0, "label": 6.0}), (2, {"label": 7.0, "a": 1.0}), (3, {"a": 2.0})], "k long, m map<string, double>")
    got = df.select("k", io.own_target(F.col("m"), "price").alias("named"), io.own_target(F.col("m")).alias("free")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 5.0, 6.0), (2, 7.0, 7.0), (3, 2.0, 2.0)]
    with pytest.raises(Exception, match="no property to predict in a, b"):
        spark.createDataFrame([({"a": 1.0, "b": 2.0},)], "m map<string, double>").select(io.own_target(F.col("m"), "price")).collect()


def test_packed_by_batches(spark, monkeypatch, tmp_path):
    """Graphs packed batch by batch, and longer than a batch, are those of the edges' view; repeated pairs, keys that are null and a line item without an order too."""
    from pyspark.sql import functions as F

    from walkloom.sources import views

    for t in ("orders", "part", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one = li.limit(1)
    odd = li.union(one).union(one.withColumn("l_returnflag", F.lit("N"))).union(one.withColumn("l_orderkey", F.lit(-7).cast("long")))
    odd = odd.union(one.withColumn("l_partkey", F.lit(None).cast("long"))).union(one.withColumn("l_suppkey", F.lit(-3).cast("long")))
    odd.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "TASK_ROWS", 2500)
    for by in ("customer", "order"):
        want = sorted(map(repr, views.packed_edges(views.edges(spark, str(tmp_path), by)).collect()))
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            try:
                got = views.packed(spark, str(tmp_path), by)
                assert got.schema.simpleString() == views.packed_edges(views.edges(spark, str(tmp_path), by)).schema.simpleString()
                assert sorted(map(repr, got.collect())) == want
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nodes_by_one_sort(spark, monkeypatch, tmp_path):
    """Nodes are numbered by one sort of a graph's parts and suppliers, and their numbers are those of the edges' ends; keys that are null and not in their tables too."""
    from pyspark.sql import functions as F

    from walkloom.sources import views

    for t in ("orders", "part", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one = li.limit(1)
    li.union(one).union(one.withColumn("l_partkey", F.lit(None).cast("long"))).union(one.withColumn("l_suppkey", F.lit(-3).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "TASK_ROWS", 2500)
    for by in ("customer", "order"):
        got, half = views.nodes(spark, str(tmp_path), by), views.pairs(spark, str(tmp_path), by)
        ends = half.select("graph_id", F.lit(0), "part", "src", "src_type").union(half.select("graph_id", F.lit(1), "supplier", "dst", "dst_type")).distinct()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("- Sort [graph_id") == 1 and plan.count("Window [") == 1
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, ends.collect()), key=repr)


def test_summary_without_a_join(spark):
    """Nodes without edges, loops, edges stored once or in both directions, ends that aren't nodes; graphs that are dealt once stay in their tasks."""
    from pyspark.sql import functions as F

    from walkloom.operators import graph
    from walkloom.sources import views

    nodes = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 0), (None, 0)], "graph_id long, node_id int")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 3, 3), (1, 0, 9), (3, 0, 1), (None, 0, 0)], "graph_id long, src int, dst int")
    assert sorted(map(tuple, graph.degrees(edges).dropna().collect())) == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 9, 1), (3, 0, 1), (3, 1, 1)]
    got = {r["graph_id"]: (r["n"], r["e"], r["max_degree"], r["min_degree"], r["degree_sequence"]) for r in graph.summary(nodes, edges).collect()}
    assert got == {1: (5, 3, 2, 0, [2, 2, 1, 1, 0]), 2: (1, 0, 0, 0, [0]), None: (1, 0, 0, 0, [0])}
    d = "/root/testdata/sf0.001"
    plan = graph.summary(views.nodes(spark, d), views.edges(spark, d))._jdf.queryExecution().executedPlan().toString()
    assert "[graph_id" not in "".join(x for x in plan.split("\n") if "SortMergeJoin" in x)
    assert all("REPARTITION_BY_NUM" in x for x in plan.split("\n") if "Exchange hashpartitioning(graph_id" in x)


def test_edge_tokens_are_repaired(spark):
    """O-TK3 repairs nodes and edges, each graph by itself: nodes with any even token to 2t + 1, edges with any odd one to 2t."""
    from walkloom.operators.tokenize import repaired_features

    rows = [(1, 0, 0, 1, 2, 3, 1), (1, 1, 0, 2, 2, 5, 2), (1, 2, 1, 0, 3, 2, 1), (1, 3, 2, 0, 5, 2, 2), (2, 0, 0, 1, 1, 3, 2), (2, 1, 1, 0, 3, 1, 2)]
    got = repaired_features(spark.createDataFrame(rows, "graph_id long, edge_id int, src int, dst int, src_type int, dst_type int, edge_type int"))
    tokens = lambda g, kind: [r["token"] for r in got.filter(f"graph_id = {g} and kind = '{kind}'").orderBy("id").collect()]
    assert tokens(1, "node") == [5, 7, 11] and tokens(1, "edge") == [2, 4, 2, 4]
    assert tokens(2, "node") == [1, 3] and tokens(2, "edge") == [2, 2]
    from walkloom.plans import QUERIES

    assert {r["kind"] for r in QUERIES["O-TK3"](spark, "/root/testdata/sf0.001").select("kind").distinct().collect()} == {"node", "edge"}


def test_weights_of_walks_shuffle_no_steps(spark):
    """A packed graph's walk weighs what path_weight gives, infinite over several parts, and takes one pass without a shuffle."""
    from walkloom.operators import graph
    from walkloom.sources import views

    half = [(1, 0, 2, 5, 8, 1), (1, 0, 3, 5, 9, 2), (1, 1, 3, 6, 9, 1), (2, 0, 2, 5, 8, 1), (2, 1, 3, 5, 8, 1)]
    both = sorted([x for g, s, d, a, b, t in half for x in ((g, s, d, a, b, t), (g, d, s, b, a, t))])
    edges = spark.createDataFrame([(g, k, *r) for k, (g, *r) in enumerate(both)], "graph_id long, edge_id int, src int, dst int, src_type int, dst_type int, edge_type int")
    packed, counts = views.packed_edges(edges), graph.triplets(edges)
    assert io.same(graph.packed_triplets(packed), counts)
    got = graph.walk_weight(io.saved(packed), counts)
    want = graph.path_weight(got.select("graph_id", "path"), graph.weighted(edges, counts))
    rows = lambda df: sorted((r["graph_id"], r["path"], round(r["total"], 9)) for r in df.select("graph_id", "path", "total").collect())
    assert rows(got) == rows(want) and [r[2] == float("inf") for r in rows(got)] == [False, True]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
