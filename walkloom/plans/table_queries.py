"""Queries over sequences, labels, predictions and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom import streaming
from walkloom.operators import bpe, metrics, splits, stats, vocab
from walkloom.operators import tokenize as T
from walkloom.plans.graph_queries import six
from walkloom.plans.views_sql import CHARS, CLS, EVENTS, LABELLED, PRED, VOCAB, merges
from walkloom.sources import importers, io, views
from walkloom.sources.views import table

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _labelled(s, d):
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("split", split)


def _pred(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("variant_id"), (F.length("text") % 50).cast("double").alias("y_pred"), (F.col("conv_id") * 13 % 50).cast("double").alias("y_true"))


def _cls(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select(i.alias("graph_id"), (i * 7 % 3).cast("int").alias("y_true"), ((i * 37 + F.col("n_chars")) % 3).cast("int").alias("y_pred"), ((i * 37 % 101) / 100).alias("score"), (i * 11 % 2).cast("int").alias("y"))


def _probs(s, d):
    """Three class probabilities a turn; whole numbers over their sum."""
    n = F.length("text")
    a = [(n * (k + 3) % 11 + 1).cast("double") for k in range(3)]
    return table(s, d, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("variant_id"), (F.col("conv_id") % 3).cast("int").alias("y_true"), F.array(*a).alias("probs"))


_PROBS = "WITH pb AS (SELECT conv_id AS graph_id, turn AS variant_id, CAST(conv_id % 3 AS INT) AS y_true, CAST(unnest(range(3)) AS INT) AS k, length(text) AS n FROM conversations), pv AS (SELECT graph_id, variant_id, y_true, k, CAST(n * (k + 3) % 11 + 1 AS DOUBLE) AS p FROM pb)\n"


def _runs(s, d):
    """Runs from orders: a value a customer segment (dataset) and priority (method)."""
    c = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("value"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("run_id"), "dataset", "method", "value")


_RUNS = "WITH ru AS (SELECT o_orderkey AS run_id, c_mktsegment AS dataset, o_orderpriority AS method, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)\n"

# Scans, filters
_PLACED = "SELECT doc_id AS graph_id, CASE WHEN k < floor(n * 0.8 + 1e-9) THEN 'train' WHEN k < floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, COUNT(*) OVER () AS n FROM documents)"


def _written(s, name, write, read):
    """What is read back from a new folder that write fills."""
    path = io.scratch(s, name)
    write(path)
    return read(path)


query("O-SC4", _PLACED)(lambda s, d: _written(s, "splits", lambda p: io.write_splits(p, splits.placed(table(s, d, "documents").select(F.col("doc_id").alias("graph_id")), "graph_id")), lambda p: io.read_splits(s, p)))
# The k-th line is that of the k-th document; there are fewer lines than documents.
query("O-SC5", "SELECT doc_id AS graph_id, coalesce(url, '') AS url FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) LEFT JOIN (SELECT trim(url) AS url, row_number() OVER (ORDER BY page_id) AS k FROM pages) USING (k)")(
    lambda s, d: _written(s, "lines", lambda p: table(s, d, "pages").orderBy("page_id").select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("value")).write.text(p), lambda p: io.read_aligned_lines(s, p, table(s, d, "documents").select(F.col("doc_id").alias("graph_id")), "url")))
query("O-SC6", "SELECT n_nationkey AS value, n_name AS name, CAST(n_regionkey AS DOUBLE) / 4 AS share FROM nation")(
    lambda s, d: _written(s, "csv", lambda p: table(s, d, "nation").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"), (F.col("n_regionkey") / 4).alias("share")).write.csv(p, header=True), lambda p: io.read_csv(s, p, "value int, name string, share double")))


def _metric_files(s, d):
    """A file of results a nation: some lack their method or test metrics."""
    n = table(s, d, "nation")
    test = F.when(F.col("n_nationkey") % 4 == 0, F.create_map(F.lit("mse"), F.col("n_nationkey").cast("double"), F.lit("roc_auc"), F.col("n_nationkey") / 25)).when(F.col("n_nationkey") % 4 == 1, F.create_map(F.lit("mae"), F.col("n_nationkey") / 10, F.lit("accuracy"), F.lit(0.5))).when(F.col("n_nationkey") % 4 == 2, F.create_map(F.lit("zeta"), F.lit(3.0), F.lit("eta"), F.col("n_nationkey").cast("double")))
    doc = F.to_json(F.struct(F.col("n_name").alias("dataset"), F.when(F.col("n_nationkey") % 5 != 0, "bert").alias("method"), F.lit("regression").alias("task"), test.alias("test_metrics"), (F.col("n_nationkey") / 7).alias("best_val_loss")))
    path = io.scratch(s, "metrics")
    n.select(doc.alias("value"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).repartition(5, "nation").write.partitionBy("region", "nation").text(f"{path}/tree")
    return f"{path}/tree"


query("O-SC7", "SELECT n_name AS dataset, CASE WHEN n_nationkey % 5 = 0 THEN 'method' ELSE '' END AS reason FROM nation")(
    lambda s, d: (lambda x: x[0].select("dataset", F.lit("").alias("reason")).union(x[1].select(F.get_json_object("value", "$.dataset"), "reason")))(io.read_metrics(s, _metric_files(s, d), pattern="*.txt", keep=("value",))))
query("O-AG20_files", "SELECT n_name AS dataset, CASE n_nationkey % 4 WHEN 0 THEN 'roc_auc' WHEN 1 THEN 'mae' WHEN 2 THEN 'eta' ELSE 'best_val_loss' END AS metric_name, round(CASE n_nationkey % 4 WHEN 0 THEN -n_nationkey / 25 WHEN 1 THEN n_nationkey / 10 WHEN 2 THEN n_nationkey ELSE n_nationkey / 7 END, 6) AS objective FROM nation WHERE n_nationkey % 5 <> 0")(
    lambda s, d: six(stats.objective(io.read_metrics(s, _metric_files(s, d), pattern="*.txt")[0].withColumn("metrics", F.coalesce("test_metrics", F.create_map().cast("map<string,double>")))).select("dataset", "metric_name", "objective"), "objective"))


def _triangles(s, d):
    """A data set in TU text files: a triangle a customer, its nodes and edges typed by the customer's keys; read back."""
    path, c = io.scratch(s, "tu"), table(s, d, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey") + 1  # from 1, without gaps
    each = c.select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    ends = F.concat_ws(", ", *[(3 * k - 2 + j).cast("string") for j in (F.col("j"), (F.col("j") + 1) % 3)])
    files = {"A": (each, ends), "graph_indicator": (each, k), "graph_labels": (c, F.col("c_nationkey")), "node_labels": (each, (F.col("c_nationkey") + F.col("j")) % 7), "edge_labels": (each, k % 4)}
    for name, (rows, value) in files.items():
        rows.select(*[x for x in ("c_custkey", "j") if x in rows.columns], value.cast("string").alias("value")).orderBy(*[x for x in ("c_custkey", "j") if x in rows.columns]).select("value").write.text(f"{path}/C_{name}.txt")
    graphs, nodes, edges = importers.read_tu(s, path, "C")
    return edges.join(graphs, "graph_id").join(nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), ["graph_id", "src"])


query("O-SC9", "SELECT c_custkey AS graph_id, CAST(j AS INT) AS edge_id, CAST(j AS INT) AS src, CAST((j + 1) % 3 AS INT) AS dst, CAST((c_custkey + 1) % 4 AS INT) AS edge_type, c_nationkey AS label, CAST((c_nationkey + j) % 7 AS INT) AS src_type FROM customer, range(3) AS r(j)")(_triangles)


def _counted(s, d):
    """The orders of each customer as a graph in counted files: its orders are nodes, by key; an edge goes from each to the next; written by Spark and read back."""
    path = io.scratch(s, "counted")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("o_custkey") % 6).alias("kind"))
    graphs = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    place = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("at")
    each = o.select("*", place)
    edge = each.filter("at > 0").orderBy("o_custkey", "at")
    files = {"num-node-list": graphs.orderBy("o_custkey").select(F.col("n").cast("string").alias("value")), "num-edge-list": graphs.orderBy("o_custkey").select((F.col("n") - 1).cast("string").alias("value")), "graph-label": graphs.orderBy("o_custkey").select((F.col("o_custkey") % 2).cast("string").alias("value")),
        "node-feat": each.orderBy("o_custkey", "at").select(F.concat_ws(",", (F.col("o_orderkey") % 7).cast("string"), F.lit("9")).alias("value")), "edge": edge.select(F.concat_ws(",", (F.col("at") - 1).cast("string"), F.col("at").cast("string")).alias("value")), "edge-feat": edge.select(F.concat_ws(", ", F.col("kind").cast("string"), F.lit("0")).alias("value"))}
    for name, rows in files.items():
        rows.write.text(f"{path}/{name}.csv")
    found, nodes, edges = importers.read_counted(s, path, both_ways=True)
    ends = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_type").alias("src_type"))
    return edges.join(ends, ["graph_id", "src"]).join(found, "graph_id")


query("O-SC9_counted", "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS graph_id FROM (SELECT DISTINCT o_custkey FROM orders)), n AS (SELECT graph_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pl FROM orders JOIN g USING (o_custkey)), e AS (SELECT graph_id, o_custkey, pl, unnest([0, 1]) AS back FROM n WHERE pl > 0) SELECT e.graph_id, CAST(2 * (e.pl - 1) + back AS INT) AS edge_id, CAST(e.pl - 1 + back AS INT) AS src, CAST(e.pl - back AS INT) AS dst, CAST(CASE WHEN e.o_custkey % 6 < 4 THEN e.o_custkey % 6 + 1 ELSE 0 END AS INT) AS edge_type, CAST(x.o_orderkey % 7 + 1 AS INT) AS src_type, CAST(e.o_custkey % 2 AS DOUBLE) AS label FROM e JOIN n x ON x.graph_id = e.graph_id AND x.pl = e.pl - 1 + back")(_counted)
query("O-SK1", EVENTS + "SELECT graph_id, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS tokens FROM ev GROUP BY 1")(
    lambda s, d: _written(s, "sequences", lambda p: [io.write_sequences(p, views.sequences(views.user_events(s, d)), m, k) for m, k in (("bfs", None), ("feuler", 4), ("feuler", 4))], lambda p: io.read_sequences(s, p, "feuler", 4)).withColumn("tokens", F.array_join("tokens", " ")).select("graph_id", "tokens"))
query("O-SK5", _RUNS + "SELECT dataset, method, printf('%.4f', sum(CAST(round(value * 100) AS BIGINT)) / 100.0) AS total FROM ru GROUP BY 1, 2")(
    lambda s, d: io.four_places(_runs(s, d).groupBy("dataset", "method").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("total")), ["total"]))
# Items of events, with members that describe a graph, a long text, a truth value, a list and nested properties, of which one is overridden.
_ITEM = """'{"idx": ' || CAST(event_id AS STRING) || ', "smiles": "CC", "num_nodes": 3, "kind": "' || event_type || '", "value": ' || CAST(value AS STRING) || ', "whole": ' || CAST(user_id AS STRING) || ', "even": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
|| ', "list": [1, 2], "none": null, "long": "' || repeat('x', CAST(40 + event_id % 20 AS INT)) || '", "properties": {"value": -1, "idx": 7, "inner": ' || CAST(event_id % 9 / 4 AS STRING) || ', "tag": "t' || CAST(event_id % 3 AS STRING) || '"}}'"""
_PROPS = {"kind": ("NULL", "event_type"), "value": ("value", "NULL"), "whole": ("user_id", "NULL"), "even": ("CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END", "NULL"), "idx": ("7", "NULL"), "inner": ("event_id % 9 / 4", "NULL"), "tag": ("NULL", "'t' || event_id % 3"), "long": ("NULL", "repeat('x', CAST(40 + event_id % 20 AS INT))")}
query("O-PF1", " UNION ALL ".join(f"SELECT event_id, '{k}' AS name, coalesce(CAST({n} AS DOUBLE), -1) AS number, coalesce({t}, '') AS text FROM events{' WHERE event_id % 20 < 10' if k == 'long' else ''}" for k, (n, t) in _PROPS.items()))(
    lambda s, d: io.properties(table(s, d, "events").select("event_id", F.expr(_ITEM).alias("item")), "event_id").select("event_id", "name", F.coalesce("number", F.lit(-1.0)).alias("number"), F.coalesce("text", F.lit("")).alias("text")))
_maps = lambda s, d: table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", F.create_map(F.lit("label"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice")).alias("m"))
# Rows whose maps differ: with the one named and another, the default and another, or only one.
_own = lambda: F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("z"), F.lit(1.0))).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("label"), F.col("p_size").cast("double"), F.lit("a"), F.lit(2.0))).otherwise(F.create_map(F.lit("only"), F.lit(7.0)))
# A property named, one of several by default, and the only one; and what each row's own map gives.
query("O-PF2", "SELECT p_partkey, p_retailprice AS named, CAST(p_size AS DOUBLE) AS by_default, p_retailprice AS single, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN CAST(p_size AS DOUBLE) ELSE 7.0 END AS target FROM part")(
    lambda s, d: (lambda x, found: x.select("p_partkey", io.target(F.col("m"), io.resolved_target(found, "price", "label")).alias("named"), io.target(F.col("m"), io.resolved_target(found, None, "label")).alias("by_default"), io.target(F.map_filter("m", lambda k, _: k == "price"), io.resolved_target(["price"])).alias("single"), io.own_target(F.col("own"), "price").alias("target")))(_maps(s, d).withColumn("own", _own()), io.names(_maps(s, d), "m")))
query("O-PF5", "SELECT doc_id FROM documents WHERE length(text) > 0")(lambda s, d: table(s, d, "documents").filter(F.size(T.code_points("text")) > 0).select("doc_id"))
query("O-PF6", _RUNS + "SELECT run_id FROM ru WHERE dataset IN ('BUILDING', 'MACHINERY') AND method IN ('1-URGENT', '2-HIGH')")(lambda s, d: _runs(s, d).filter(F.col("dataset").isin("BUILDING", "MACHINERY") & F.col("method").isin("1-URGENT", "2-HIGH")).select("run_id"))
query("O-TK4", "SELECT p_partkey, (p_size & 1) + (p_size & 2) + (p_size & 4) AS mask FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", T.bitmask(F.array(*[F.shiftright("p_size", k).bitwiseAND(F.lit(1)) for k in range(3)])).alias("mask")))
query("O-TK5", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS INT) AS c FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", T.argmax_class(F.col("embedding")).alias("c")))
query("O-TK10", CHARS + "SELECT graph_id, COUNT(*) AS n, md5(string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos)) AS points FROM dc GROUP BY 1")(
    lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("graph_id"), T.code_points("text").alias("t")).filter(F.size("t") > 0).select("graph_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("points")))
_joined = lambda c: F.md5(F.array_join(c, " ").cast("binary"))
query("O-SE8", CHARS + "SELECT graph_id, COUNT(*) AS n, md5(string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos)) AS tokens FROM dc GROUP BY 1")(lambda s, d: views.doc_sequences(s, d).filter(F.size("tokens") > 0).select("graph_id", F.size("tokens").cast("long").alias("n"), _joined("tokens").alias("tokens")))
# Other columns of strings of a graph, as smiles_1 to smiles_4.
for _k, _c in enumerate(("p_name", "p_brand", "p_type"), 1):
    query(f"O-SE8_{_k}", f"SELECT p_partkey AS graph_id, {_c} AS text, len({_c}) AS n FROM part")(
        lambda s, d, c=_c: T.texts_to_points(table(s, d, "part").select(F.col("p_partkey").alias("graph_id"), F.col(c).alias("text"))).select("graph_id", F.concat_ws("", F.transform("tokens", lambda t: F.char(t))).alias("text"), F.size("tokens").cast("long").alias("n")))
query("O-TK13", "WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS v FROM embeddings) SELECT CAST(col AS INT) AS col, CAST(min(v) AS FLOAT) AS lo, CAST(max(v) AS FLOAT) AS hi, bool_and(v = floor(v)) AS whole, bool_and(v IN (0, 1)) AS binary FROM x GROUP BY 1")(lambda s, d: T.discrete_columns(table(s, d, "embeddings"), "embedding"))

# BPE
_seqs = lambda s, d: views.sequences(views.user_events(s, d))
query("O-BP1", EVENTS + 'SELECT left_ AS "left", right_ AS "right", cnt FROM pc')(lambda s, d: bpe.pair_counts(_seqs(s, d)))
query("O-BP2", EVENTS + 'SELECT left_ AS "left", right_ AS "right", cnt FROM pc ORDER BY cnt DESC, 1, 2 LIMIT 1')(lambda s, d: bpe.best_pair(bpe.pair_counts(_seqs(s, d))))
query("O-BP3", EVENTS + ", h AS (SELECT *, tok = 0 AND nxt = 0 AS hit FROM nx WHERE true), g AS (SELECT *, pos - sum(CAST(hit AS INT)) OVER (PARTITION BY graph_id ORDER BY pos) AS grp FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY graph_id, hit, grp ORDER BY pos) AS k FROM g), t AS (SELECT *, hit AND k % 2 = 1 AS take FROM k), f AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY graph_id ORDER BY pos), false) AS gone FROM t) SELECT graph_id, string_agg(CASE WHEN take THEN '9' ELSE CAST(tok AS VARCHAR) END, ' ' ORDER BY pos) AS tokens FROM f WHERE NOT gone GROUP BY 1")(
    lambda s, d: _seqs(s, d).select("graph_id", F.array_join(bpe.merged("tokens", 0, 0, 9), " ").alias("tokens")))
_RULES = merges(6) + " " + " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right", new_id, cnt FROM r{k}' for k in range(6))
query("O-BP4", _RULES)(lambda s, d: bpe.train(_seqs(s, d), merges=6, min_frequency=2))
query("O-BP4_50")(lambda s, d: bpe.train(_seqs(s, d), merges=50, min_frequency=2))
# Counts are kept up to date merge by merge; the SQL counts anew.
query("O-BP5", _RULES)(lambda s, d: bpe.train(_seqs(s, d), merges=6, strategy="local"))
query("O-BP6", EVENTS + "SELECT COUNT(DISTINCT tok) AS base, max(tok) + 1 AS separator, CAST(10 AS BIGINT) AS merges, COUNT(DISTINCT tok) + 10 AS vocab_size FROM ev")(lambda s, d: bpe.vocab_size(_seqs(s, d), bpe.train(_seqs(s, d), merges=10)))


def _encoded(s, d, limit=None):
    rules = bpe.train(_seqs(s, d), merges=6)
    return bpe.decode(bpe.encode(_seqs(s, d), rules, limit), rules)


query("O-BP7", merges(6) + " SELECT graph_id, array_to_string(t, ' ') AS encoded FROM s6")(lambda s, d: _encoded(s, d).select("graph_id", F.array_join("encoded", " ").alias("encoded")))
_USED = " UNION ALL ".join(f"SELECT DISTINCT graph_id, {k} AS k FROM zs{k + 1} WHERE take" for k in range(3))
query("O-BP8", merges(3) + f", us AS (SELECT graph_id, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY k) AS ranks FROM ({_USED}) GROUP BY 1) SELECT graph_id, array_to_string(t, ' ') AS encoded, coalesce(ranks, '') AS ranks FROM s3 LEFT JOIN us USING (graph_id)")(
    lambda s, d: _encoded(s, d, 3).select("graph_id", F.array_join("encoded", " ").alias("encoded"), F.array_join("ranks", " ").alias("ranks")))


def _draw(salt):
    return f"CAST('0x' || substr(md5(graph_id || ':42:{salt}'), 1, 12) AS BIGINT) / {float(1 << 48)}"


_GAUSS = "coalesce(" + ", ".join(f"(SELECT x FROM (SELECT CAST(trunc(50 + sqrt(-2 * ln(greatest({_draw(f'a{t}')}, 1e-12))) * cos(2 * pi() * {_draw(f'b{t}')}) * 50 / 3.0) AS BIGINT) AS x) WHERE x BETWEEN 0 AND 50)" for t in range(8)) + ", 50)"
query("O-BP9", EVENTS + f"SELECT DISTINCT graph_id, 0 AS none, 50 AS all_, 20 AS topk, CAST(floor({_draw('r')} * 51) AS INT) AS random, CAST(floor(50 * sqrt({_draw('t')})) AS INT) AS triangular, CAST({_GAUSS} AS INT) AS gaussian FROM (SELECT DISTINCT graph_id FROM ev)")(
    lambda s, d: _seqs(s, d).select("graph_id", *[bpe.rank_limit(m, 50, 20).alias({"all": "all_"}.get(m, m)) for m in ("none", "all", "topk", "random", "triangular", "gaussian")]))
_MODE = "CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'all' WHEN 2 THEN 'topk' WHEN 3 THEN 'random' WHEN 4 THEN 'triangular' ELSE 'gaussian' END"
query("O-BP10", f"SELECT o_orderkey, mode, CAST(greatest(0, least(50, CASE mode WHEN 'none' THEN 0 WHEN 'all' THEN 50 WHEN 'topk' THEN k WHEN 'gaussian' THEN coalesce(k, hi) ELSE round_even((lo + hi) / 2, 0) END)) AS INT) AS rank_limit FROM (SELECT o_orderkey, {_MODE} AS mode, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 70 END AS k, o_custkey % 20 AS lo, o_custkey % 20 + o_orderkey % 45 AS hi FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_MODE).alias("mode"), F.expr("CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 70 END").alias("k"), (F.col("o_custkey") % 20).alias("lo"), (F.col("o_custkey") % 20 + F.col("o_orderkey") % 45).alias("hi")).select("o_orderkey", "mode", bpe.eval_limit(F.col("mode"), 50, F.col("k"), F.col("lo"), F.col("hi")).alias("rank_limit")))
query("O-BP11", merges(6) + f", lim AS (SELECT graph_id, CAST(floor({_draw('r')} * 7) AS INT) AS k FROM s0) SELECT graph_id, k, CASE k " + " ".join(f"WHEN {k} THEN (SELECT array_to_string(t, ' ') FROM s{k} x WHERE x.graph_id = lim.graph_id)" for k in range(7)) + " END AS encoded FROM lim")(
    lambda s, d: bpe.encode(_seqs(s, d).withColumn("k", bpe.rank_limit("random", 6)), bpe.train(_seqs(s, d), merges=6), limit_column="k").select("graph_id", "k", F.array_join("encoded", " ").alias("encoded")))
query("O-BP12", EVENTS + "SELECT graph_id, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS decoded FROM ev GROUP BY 1")(lambda s, d: _encoded(s, d).select("graph_id", F.array_join("decoded", " ").alias("decoded")))
query("O-BP13", merges(6) + " SELECT COUNT(*) AS sequences, CAST(sum(len(s0.t)) AS BIGINT) AS before, CAST(sum(len(s6.t)) AS BIGINT) AS after, 1.0 AS exact, CAST(sum(len(s0.t)) - sum(len(s6.t)) AS BIGINT) AS saved, round(sum(len(s6.t)) / sum(len(s0.t)), 6) AS ratio FROM s0 JOIN s6 USING (graph_id)")(lambda s, d: six(bpe.compression(_encoded(s, d)), "ratio", "exact"))
query("O-BP14", EVENTS + "SELECT CAST(sum(cnt) AS BIGINT) AS total, COUNT(*) AS distinct_pairs, round(sum(cnt) / (SELECT COUNT(DISTINCT graph_id) FROM ev), 6) AS per_sequence FROM pc")(
    lambda s, d: bpe.pair_counts(_seqs(s, d)).agg(F.sum("cnt").alias("total"), F.count("*").alias("distinct_pairs")).crossJoin(_seqs(s, d).agg(F.count("*").alias("n"))).select("total", "distinct_pairs", F.round(F.col("total") / F.col("n"), 6).alias("per_sequence")))
# A new token holds one base token for each of its parts that is one, and those of its parts that are new.
_HELD = "".join(f", e{k} AS (SELECT new_id, coalesce((SELECT sum(n) FROM (SELECT n FROM (" + (" UNION ALL ".join(f"SELECT new_id, n FROM e{j}" for j in range(k)) or "SELECT NULL AS new_id, NULL AS n") + f") o WHERE o.new_id = r{k}.l)), 1) + coalesce((SELECT sum(n) FROM (SELECT n FROM (" + (" UNION ALL ".join(f"SELECT new_id, n FROM e{j}" for j in range(k)) or "SELECT NULL AS new_id, NULL AS n") + f") o WHERE o.new_id = r{k}.r)), 1) AS n FROM r{k})" for k in range(6))
query("O-BP15_few", merges(6) + _HELD + " SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '>10' END AS size, COUNT(*) AS tokens FROM (" + " UNION ALL ".join(f"SELECT n FROM e{k}" for k in range(6)) + ") GROUP BY 1")(lambda s, d: bpe.codebook_sizes(bpe.train(_seqs(s, d), merges=6)))
query("O-BP15")(lambda s, d: bpe.codebook_sizes(bpe.train(_seqs(s, d), merges=50)))
query("O-BP15_patterns")(lambda s, d: bpe.codebook_patterns(bpe.train(T.texts_to_points(table(s, d, "part").select(F.col("p_partkey").alias("graph_id"), F.col("p_name").alias("text"))), merges=60), targets=("ing", "er")))
query("O-BP16_texts")(lambda s, d: bpe.train(views.doc_sequences(s, d), merges=40, min_frequency=20))
query("O-BP17", _RULES)(lambda s, d: bpe.train(_seqs(s, d), 6, strategy="distributed"))
query("O-SK2", _RULES)(lambda s, d: _written(s, "codebook", lambda p: io.write_codebook(f"{p}.json", bpe.train(_seqs(s, d), merges=6)), lambda p: io.read_codebook(s, f"{p}.json")))

# Vocabulary
query("O-VO1", CHARS + "SELECT tok, COUNT(*) AS cnt FROM dc GROUP BY 1")(lambda s, d: vocab.frequencies_of(views.doc_sequences(s, d)).select("tok", "cnt"))
_vocab = lambda s, d, least=1: vocab.build(vocab.frequencies_of(views.doc_sequences(s, d)), least)
query("O-VO2", VOCAB + "SELECT * FROM vo")(lambda s, d: _vocab(s, d))
query("O-SK3", VOCAB + "SELECT * FROM vo")(lambda s, d: _written(s, "vocab", lambda p: io.write_vocab(p, _vocab(s, d)), lambda p: io.read_vocab(s, p)))
query("O-VO3", EVENTS + "SELECT CAST(tok AS INT) AS tok, COUNT(*) AS cnt FROM ev GROUP BY 1 UNION ALL SELECT 6, 1")(lambda s, d: vocab.with_all(vocab.frequencies(views.user_events(s, d)), bpe.train(_seqs(s, d), merges=1)))
query("O-VO4", VOCAB + "SELECT graph_id, COUNT(*) AS n, md5(string_agg(CAST(coalesce(CASE WHEN freq >= 50 THEN vocab_id END, 1) AS VARCHAR), ' ' ORDER BY pos)) AS ids FROM dc LEFT JOIN vo ON token = tok GROUP BY 1")(
    lambda s, d: vocab.ids_of(views.doc_sequences(s, d), _vocab(s, d, 50)).filter(F.size("tokens") > 0).select("graph_id", F.size("tokens").cast("long").alias("n"), _joined("tokens").alias("ids")))
query("O-VO5", VOCAB + ", i AS (SELECT graph_id, pos, vocab_id FROM dc JOIN vo ON token = tok WHERE pos < 46), e AS (SELECT graph_id, '3,' || string_agg(CAST(vocab_id AS VARCHAR), ',' ORDER BY pos) || ',4' || repeat(',0', CAST(46 - COUNT(*) AS INT)) AS input_ids, COUNT(*) + 2 AS used FROM i GROUP BY 1) SELECT * FROM e")(
    lambda s, d: vocab.framed(vocab.ids_of(views.doc_sequences(s, d).select("graph_id", F.slice("tokens", 1, 46).alias("tokens")), _vocab(s, d)).filter(F.size("tokens") > 0), 48).select("graph_id", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("used")))
query("O-VO6", VOCAB + ", t AS (SELECT COUNT(*) AS types, COUNT(*) FILTER (freq < 50) AS unknown FROM vo) SELECT types, unknown, round(unknown / types, 6) AS ratio, CASE WHEN unknown / types <= 0.05 THEN 'ok' WHEN unknown / types <= 0.1 THEN 'warn' ELSE 'fail' END AS verdict FROM t")(
    lambda s, d: six(vocab.compatibility(vocab.frequencies_of(views.doc_sequences(s, d)), _vocab(s, d, 50)), "ratio"))
query("O-VO7", "SELECT 'sigma' AS policy, least(CAST(ceil(avg(n_chars) + 3 * stddev_pop(n_chars)) AS BIGINT) + 2, 8096) AS max_len FROM documents UNION ALL SELECT 'max', least(max(n_chars) + 2, 8096) FROM documents UNION ALL SELECT 'short', least(max(n_chars) + 2, 768) FROM documents")(
    lambda s, d: (lambda n: vocab.length_policy(n, "sigma", positions=9000).select(F.lit("sigma").alias("policy"), "max_len").union(vocab.length_policy(n).select(F.lit("max"), "max_len")).union(vocab.length_policy(n, cap=768, positions=768).select(F.lit("short"), "max_len")))(table(s, d, "documents").select(F.col("n_chars").alias("n"))))
_U = lambda what: vocab.uniform_sql(f"{what}:42", "graph_id", "pos")
query("O-VO8", VOCAB + f", m AS (SELECT graph_id, pos, vocab_id AS x, vocab_id >= 8 AND {_U('draw')} < 0.15 AS drawn, {_U('how')} AS how, CAST(8 + floor({_U('token')} * (SELECT COUNT(*) FROM vo)) AS INT) AS other FROM dc JOIN vo ON token = tok) SELECT graph_id, COUNT(*) FILTER (drawn) AS masked, md5(string_agg(CAST(CASE WHEN NOT drawn THEN x WHEN how < 0.8 THEN 2 WHEN how < 0.9 THEN other ELSE x END AS VARCHAR), ' ' ORDER BY pos)) AS input_ids, md5(string_agg(CAST(CASE WHEN drawn THEN x ELSE -100 END AS VARCHAR), ' ' ORDER BY pos)) AS labels FROM m GROUP BY 1")(
    lambda s, d: (lambda v: vocab.masked(vocab.ids_of(views.doc_sequences(s, d), v).filter(F.size("tokens") > 0), v.count() + len(vocab.SPECIALS)))(io.saved(_vocab(s, d), "vocab")).select("graph_id", F.size(F.array_remove("labels", -100)).cast("long").alias("masked"), _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels")))
# Augmentations: a gate of 0.7 by sequence, a ratio of 0.1, what is put in from 0 to 4. Swaps follow one another, which SQL can't express.
_AUG = EVENTS.rstrip() + ", n AS (SELECT *, COUNT(*) OVER (PARTITION BY graph_id) AS n FROM ev), g AS (SELECT *, CAST(floor(n * 0.1 + 1e-9) AS INT) AS k, {gate} <= 0.7 AS go, row_number() OVER (PARTITION BY graph_id ORDER BY {place}, pos) AS place, {token} AS token, {start} AS u1, {end} AS u2 FROM n), c AS (SELECT *, greatest(1, k) AS least, CAST(floor(u1 * (n - greatest(1, k) + 1)) AS INT) AS b FROM g) SELECT graph_id, string_agg(CAST({new} AS VARCHAR), ' ' ORDER BY pos) AS tokens FROM c WHERE {keep} GROUP BY 1"
_NEW = {
    "deletion": ("tok", "NOT (go AND n > 1 AND place <= least(k, n - 1))"), "replacement": ("CASE WHEN go AND place <= k THEN CAST(floor(token * 5) AS INT) ELSE tok END", "true"),
    "truncation": ("tok", "NOT (go AND n > 1 AND least < n) OR pos >= b AND pos < b + least + CAST(floor(u2 * (n - b - least + 1)) AS INT)"), "masking": ("CASE WHEN go AND n > 1 AND place <= greatest(1, least(k, n - 1)) THEN 2 ELSE tok END", "true"),
}
for _h in ("deletion", "insertion", "replacement", "swap", "truncation", "masking"):
    _u = lambda what, place="0", h=_h: vocab.uniform_sql(f"{h}:{what}:0", "graph_id", place)
    query(f"O-VO9_{_h}", _AUG.format(gate=_u("gate"), place=_u("place", "pos"), token=_u("token", "pos"), start=_u("start"), end=_u("end"), new=_NEW[_h][0], keep=_NEW[_h][1]) if _h in _NEW else None)(
        lambda s, d, h=_h: vocab.augmented(_seqs(s, d), h, p=0.7, valid=(0, 1, 2, 3, 4)).select("graph_id", F.array_join("tokens", " ").alias("tokens")))
query("O-VO10", "SELECT conv_id AS graph_id, turn AS variant_id FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")(lambda s, d: vocab.one_variant(_pred(s, d)).select("graph_id", "variant_id"))
_price = lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("y"))
query("O-VO11", "SELECT 'standard' AS how, round(avg(p_retailprice), 6) AS shift, round(stddev_pop(p_retailprice), 6) AS scale FROM part UNION ALL SELECT 'minmax', min(p_retailprice), round(max(p_retailprice) - min(p_retailprice), 6) FROM part UNION ALL SELECT 'robust', round(quantile_cont(p_retailprice, 0.5), 6), round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) FROM part")(
    lambda s, d: (lambda x: x[0].union(x[1]).union(x[2]))([six(vocab.scaler(_price(s, d), h), "shift", "scale").select(F.lit(h).alias("how"), "shift", "scale") for h in ("standard", "minmax", "robust")]))

_MS = {"standard": ("avg(p_retailprice)", "stddev_pop(p_retailprice)"), "minmax": ("min(p_retailprice)", "max(p_retailprice) - min(p_retailprice)"), "robust": ("quantile_cont(p_retailprice, 0.5)", "quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)")}
# Fitted on one part, used on all, and back.
query("O-VO11_scaled", " UNION ALL ".join(f"SELECT '{h}' AS how, p_partkey, round((p_retailprice - a) / b, 6) AS z, round(p_retailprice, 6) AS y FROM part, (SELECT {a} AS a, {b} AS b FROM part WHERE p_partkey % 10 < 8)" for h, (a, b) in _MS.items()))(
    lambda s, d: (lambda x: x[0].union(x[1]).union(x[2]))([(lambda sc: six(vocab.scaled(vocab.scaled(_price(s, d), sc).drop("y"), sc, inverse=True), "z", "y").select(F.lit(h).alias("how"), "p_partkey", "z", "y"))(vocab.scaler(_price(s, d).filter("p_partkey % 10 < 8"), h)) for h in _MS]))

# Statistics
query("O-AG2", "WITH m AS (SELECT avg(n_chars) AS mean, stddev_samp(n_chars) AS std FROM documents) SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(mean - 3 * std, 6) AS low, round(mean + 3 * std, 6) AS high, round(avg(CASE WHEN n_chars BETWEEN mean - 3 * std AND mean + 3 * std THEN 1.0 ELSE 0.0 END), 6) AS covered FROM documents, m GROUP BY mean, std")(
    lambda s, d: six(stats.three_sigma(table(s, d, "documents"), "n_chars"), "mean", "std", "low", "high", "covered"))
query("O-AG3", "WITH m AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s, max(n_chars) AS hi FROM documents), u AS (SELECT hi, CAST(ceil(m + s) AS BIGINT) AS u1, CAST(ceil(m + 2 * s) AS BIGINT) AS u2, CAST(ceil(m + 3 * s) AS BIGINT) AS u3 FROM m), c AS (SELECT hi, u1, u2, u3, avg(CAST(n_chars <= u1 AS INT)) AS c1, avg(CAST(n_chars <= u2 AS INT)) AS c2, avg(CAST(n_chars <= u3 AS INT)) AS c3 FROM documents, u GROUP BY ALL) SELECT hi, u1, u2, u3, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, CASE WHEN u3 >= hi OR 1 - c3 <= 0.001 THEN u3 ELSE hi END AS recommended FROM c")(
    lambda s, d: six(stats.length_bounds(table(s, d, "documents"), "n_chars"), "c1", "c2", "c3"))
query("O-AG4", "SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY 1")(lambda s, d: six(stats.quantiles(table(s, d, "documents"), "n_chars", "lang"), "p50", "p90", "p95", "p99"))
_CC = LABELLED.rstrip() + ", sp AS (SELECT DISTINCT split FROM lab), cc AS (SELECT sp.split, CAST(k.range AS INT) AS quality, COUNT(lab.doc_id) AS cnt FROM sp CROSS JOIN range(3) k LEFT JOIN lab ON lab.split = sp.split AND lab.quality = k.range GROUP BY 1, 2), sh AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY split) AS share, row_number() OVER (PARTITION BY split ORDER BY cnt) AS r FROM cc)"
query("O-AG5", _CC + " SELECT split, quality, cnt, round(share, 6) AS share FROM sh")(lambda s, d: six(stats.class_counts(_labelled(s, d), "quality", 3, "split"), "share"))
_bal = lambda s, d: stats.balance(stats.class_counts(_labelled(s, d), "quality", 2, "split"), "split")
_C2 = _CC.replace("range(3)", "range(2)")
query("O-AG6", _C2 + " SELECT split, round(-sum(greatest(share, 1e-12) * ln(greatest(share, 1e-12))) / ln(COUNT(*)), 6) AS entropy_norm FROM sh GROUP BY 1")(lambda s, d: six(_bal(s, d).select("split", "entropy_norm"), "entropy_norm"))
query("O-AG7", _C2 + " SELECT split, round((1 - sum(share * share)) / (1 - 1.0 / COUNT(*)), 6) AS gini_impurity_norm FROM sh GROUP BY 1")(lambda s, d: six(_bal(s, d).select("split", "gini_impurity_norm"), "gini_impurity_norm"))
query("O-AG8", _C2 + " SELECT split, round(CASE WHEN min(cnt) = 0 THEN CAST('infinity' AS DOUBLE) ELSE max(cnt) / min(cnt) END, 6) AS imbalance FROM sh GROUP BY 1")(lambda s, d: six(_bal(s, d).select("split", "imbalance"), "imbalance"))
query("O-AG9", _C2 + " SELECT split, round(stddev_pop(cnt) / avg(cnt), 6) AS cv, round(sum(CASE WHEN share > 0 THEN share * ln(share) END) + ln(COUNT(*)), 6) AS kl FROM sh GROUP BY 1")(lambda s, d: six(_bal(s, d).select("split", "cv", "kl"), "cv", "kl"))
query("O-AG10", _CC + " SELECT split, CASE WHEN min(cnt) > 0 AND max(cnt) / min(cnt) >= 1.5 THEN true ELSE stddev_pop(cnt) / avg(cnt) >= 0.2 OR -sum(greatest(share, 1e-12) * ln(greatest(share, 1e-12))) / ln(COUNT(*)) <= 0.98 END AS flagged, round(CASE WHEN min(cnt) = 0 THEN CAST('infinity' AS DOUBLE) ELSE max(cnt) / min(cnt) END, 6) AS imbalance FROM sh GROUP BY 1")(
    lambda s, d: six(stats.balance(stats.class_counts(_labelled(s, d), "quality", 3, "split"), "split").select("split", "flagged", "imbalance"), "imbalance"))
# A class that is empty: the ratio isn't finite and doesn't count, the deviation does; nearly even classes; uneven ones.
_CLASS = "CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN p_partkey % 2 ELSE CASE WHEN p_partkey % 8 < 5 THEN 0 ELSE 1 END END"
query("O-AG10_empty", f"WITH c AS (SELECT p_size % 3 AS split, COUNT(*) FILTER ({_CLASS} = 0) AS a, COUNT(*) FILTER ({_CLASS} = 1) AS b FROM part GROUP BY 1), h AS (SELECT *, greatest(a / (a + b), 1e-12) AS p, greatest(b / (a + b), 1e-12) AS q, abs(a - b) / (a + b) AS cv FROM c) SELECT split, least(a, b) > 0 AND greatest(a, b) / nullif(least(a, b), 0) >= 1.5 OR cv >= 0.2 OR -(p * ln(p) + q * ln(q)) / ln(2) <= 0.98 AS flagged FROM h")(
    lambda s, d: stats.balance(stats.class_counts(table(s, d, "part").select((F.col("p_size") % 3).alias("split"), F.expr(_CLASS).cast("int").alias("label")), "label", 2, "split"), "split").select("split", "flagged"))
query("O-AG11", LABELLED + "SELECT split, 0 AS label, CAST(sum(quality) AS BIGINT) AS cnt, COUNT(*) AS n FROM lab GROUP BY 1 UNION ALL SELECT split, 1, CAST(sum(toxic) AS BIGINT), COUNT(*) FROM lab GROUP BY 1")(lambda s, d: stats.positives(_labelled(s, d).withColumn("v", F.array("quality", "toxic")), "v", "split"))
query("O-AG12", LABELLED + "SELECT split, COUNT(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS lo, max(n_chars) AS hi, CAST(sum(n_chars) AS BIGINT) AS total FROM lab GROUP BY 1")(lambda s, d: six(stats.moments(_labelled(s, d), "n_chars", "split"), "mean", "std"))
query("O-AG13", "WITH c AS (SELECT CAST(quality AS INT) AS quality, COUNT(*) AS cnt FROM labels GROUP BY 1) SELECT quality, round(sum(cnt) OVER () / (COUNT(*) OVER () * cnt), 6) AS weight FROM c")(lambda s, d: six(stats.class_weights(stats.class_counts(table(s, d, "labels"), "quality", 2)).select("quality", "weight"), "weight"))
query("O-AG14", _RUNS + "SELECT dataset, method, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(coalesce(var_samp(value), 0) / 1e6, 4) AS var, min(value) AS lo, max(value) AS hi, round(median(value), 4) AS median, COUNT(value) AS n FROM ru GROUP BY 1, 2")(
    lambda s, d: stats.run_statistics(_runs(s, d), "value", "dataset", "method").withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")} | {"var": F.round(F.col("var") / 1e6, 4)}))
query("O-AG15", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN greatest(p_retailprice, p_size * 30.0) ELSE least(p_retailprice, p_size * 30.0) END AS fair FROM part")(lambda s, d: stats.fair_best(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("avg"), (F.col("p_size") * 30.0).alias("learned"), (F.col("p_size") % 2 == 0).alias("maximise"))).select("p_partkey", "fair"))
_MODES3 = ("avg", "best", "learned")
_RUN_CELLS = {("val", "", "mae"): "o_totalprice / 7", ("val", "", "accuracy"): "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 9 END", ("time", "", "total_train_time_sec"): "o_totalprice / 3", ("train", "", "last_loss"): "o_totalprice / 11"}
_RUN_CELLS |= {("test", m, k): f"CASE WHEN o_orderkey % 3 {'=' if k == 'roc_auc' else '<>' if k == 'rmse' else '>='} 0 THEN o_totalprice / {5 + 2 * i + j} END" for i, m in enumerate(_MODES3) for j, k in enumerate(("roc_auc", "rmse", "pk"))}


def _experiments(s, d):
    """Runs from orders: a third are classification; results by mode, some missing."""
    cell = lambda section, mode="": F.map_filter(F.create_map(*[x for (a, m, k), e in _RUN_CELLS.items() if (a, m) == (section, mode) for x in (F.lit(k), F.expr(e).cast("double"))]), lambda _, v: v.isNotNull())
    test = F.create_map(*[x for m in _MODES3 for x in (F.lit(m), cell("test", m))])
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderkey") % 3 == 0, "classification").otherwise("regression").alias("task"), cell("val").alias("val"), test.alias("test"), cell("time").alias("time"), cell("train").alias("train"))


_FIGURES = "round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(median(v), 4) AS median, COUNT(v) AS n"
query("O-AG16", "SELECT method, section, mode, metric, " + _FIGURES + " FROM (" + " UNION ALL ".join(f"SELECT o_orderpriority AS method, '{a}' AS section, '{m}' AS mode, '{k}' AS metric, {e} AS v FROM orders" for (a, m, k), e in _RUN_CELLS.items()) + ") WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4")(
    lambda s, d: stats.rolled_up(_experiments(s, d), "method").drop("var").withColumns({c: F.round(c, 4) for c in ("mean", "std", "lo", "hi", "median")}))
query("O-AG16_pk", "SELECT method, mode, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM (" + " UNION ALL ".join(f"SELECT o_orderpriority AS method, '{m}' AS mode, {_RUN_CELLS['test', m, 'pk']} AS v FROM orders" for m in _MODES3) + ") GROUP BY 1, 2")(
    lambda s, d: stats.pk_summary(stats.rolled_up(_experiments(s, d), "method"), "method").withColumns({c: F.round(c, 4) for c in ("mean", "std")}))
query("O-AG17", _RUNS + "SELECT run_id, dataset, method, round(value / 7, 4) AS value FROM ru")(lambda s, d: _runs(s, d).select(F.struct("run_id", "dataset").alias("config"), F.struct("method", (F.col("value") / 7).alias("value")).alias("test")).select("config.run_id", "config.dataset", "test.method", F.round("test.value", 4).alias("value")))
query("O-AG18", _RUNS + "SELECT method, dataset, COUNT(*) AS n, round(avg(value), 4) AS mean FROM ru GROUP BY 1, 2")(lambda s, d: _runs(s, d).groupBy("method", "dataset").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")))
# Sequences of events before and after merges, by data set (a third of the users), method and variants; what a row took is given.
query("O-AG19", merges(6) + ", x AS (SELECT graph_id, graph_id % 3 AS dataset, graph_id % 2 AS k, len(s0.t) AS a, len(s6.t) AS b, len(s0.t) * (1 + graph_id % 5) / 1000 AS seconds FROM s0 JOIN s6 USING (graph_id)) SELECT dataset, k, COUNT(DISTINCT graph_id) AS graphs, COUNT(*) AS sequences, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after, round(sum(b) / sum(a), 6) AS compression, round(COUNT(*) / sum(seconds), 4) AS graphs_per_s, round(sum(a) / sum(seconds), 4) AS tokens_per_s FROM x GROUP BY 1, 2")(
    lambda s, d: stats.efficiency(_encoded(s, d).select("graph_id", (F.col("graph_id") % 3).alias("dataset"), (F.col("graph_id") % 2).alias("k"), F.size("tokens").alias("n_before"), F.size("encoded").alias("n_after"), (F.size("tokens") * (1 + F.col("graph_id") % 5) / 1000).alias("seconds")), "dataset", "k").drop("seconds").withColumns({"compression": F.round("compression", 6), "graphs_per_s": F.round("graphs_per_s", 4), "tokens_per_s": F.round("tokens_per_s", 4)}))
_M = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("double"))])


def _results(s, d):
    """Parts with test metrics of which some are looked for in order and some only by name."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    found = F.when(size % 5 == 0, _M(("mse", size), ("accuracy", size), ("rmse", price))).when(size % 5 == 1, _M(("mse", size), ("accuracy", size), ("roc_auc", price)))
    found = found.when(size % 5 == 2, _M(("mse", price), ("recall", price), ("precision", size))).when(size % 5 == 3, _M(("beta", size), ("alpha", price)))
    return table(s, d, "part").select("p_partkey", found.otherwise(F.create_map().cast("map<string,double>")).alias("metrics"), F.lit(0.5).alias("best_val_loss"))


query("O-AG20", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'rmse' WHEN 1 THEN 'roc_auc' WHEN 2 THEN 'precision' WHEN 3 THEN 'alpha' ELSE 'best_val_loss' END AS metric_name, CASE p_size % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_retailprice WHEN 2 THEN CAST(-p_size AS DOUBLE) WHEN 3 THEN p_retailprice ELSE 0.5 END AS objective FROM part")(
    lambda s, d: stats.objective(_results(s, d)).select("p_partkey", "metric_name", "objective"))
_KINDS = {"labels": {"quality": "quality", "both": "array(quality, toxic)"}, "embeddings": {"label": "label", "vector": "transform(embedding, x -> cast(x as double))"}, "events": {"value": "value", "props": "from_json(props, 'map<string,double>')"}, "documents": {"lang": "lang"}}
query("O-AG21", "SELECT 'quality' AS label, 'classification' AS kind, COUNT(DISTINCT quality) AS targets FROM labels UNION ALL SELECT 'label', 'classification', COUNT(DISTINCT label) FROM embeddings UNION ALL SELECT 'value', 'regression', 1 UNION ALL SELECT 'lang', 'unknown', -1 UNION ALL SELECT 'both', 'multi_label_classification', 2 UNION ALL SELECT 'vector', 'multi_target_regression', max(len(embedding)) FROM embeddings UNION ALL SELECT 'props', 'multi_property_regression', max(len(json_keys(props))) FROM events")(
    lambda s, d: reduce(lambda a, b: a.union(b), [stats.label_kind(table(s, d, t).select(F.expr(e).alias(n)), n) for t, xs in _KINDS.items() for n, e in xs.items()]).withColumn("targets", F.coalesce("targets", F.lit(-1))))
query("O-AG21_size")(lambda s, d: stats.file_size(table(s, d, "documents")))
_METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
query("pivot", _RUNS + "SELECT dataset, " + ", ".join(f"round(avg(value) FILTER (method = '{m}'), 4) AS m{k}" for k, m in enumerate(_METHODS)) + " FROM ru GROUP BY 1")(
    lambda s, d: stats.pivoted(_runs(s, d), "dataset", "method", "value", _METHODS).select("dataset", *[F.round(f"`{m}`", 4).alias(f"m{k}") for k, m in enumerate(_METHODS)]))
query("rollup", LABELLED + "SELECT split, COUNT(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM lab GROUP BY 1 UNION ALL SELECT 'overall', COUNT(*), CAST(sum(quality) AS BIGINT) FROM lab")(
    lambda s, d: stats.with_overall(_labelled(s, d), "split", F.count("*").alias("n"), F.sum("quality").alias("good")))
query("tasks", "SELECT row_number() OVER (ORDER BY a.x, b.x, c.x) - 1 AS task_id, a.x AS dataset, b.x AS method, c.x AS seed FROM (SELECT DISTINCT c_mktsegment AS x FROM customer) a, (SELECT DISTINCT o_orderpriority AS x FROM orders) b, (SELECT DISTINCT n_regionkey AS x FROM nation) c")(
    lambda s, d: stats.tasks(dataset=table(s, d, "customer").select("c_mktsegment"), method=table(s, d, "orders").select("o_orderpriority"), seed=table(s, d, "nation").select("n_regionkey")))
query("O-AG22", _RUNS + "SELECT method, round(avg(value), 4) AS mean, CAST(rank() OVER (ORDER BY avg(value) DESC) AS INT) AS place FROM ru GROUP BY 1")(
    lambda s, d: _runs(s, d).groupBy("method").agg(F.avg("value").alias("m")).select("method", F.round("m", 4).alias("mean"), F.expr("cast(rank() over (order by m desc) as int)").alias("place")))

# Evaluation
query("O-EV1", PRED + "SELECT graph_id, any_value(y_true) AS y_true, round(avg(y_pred), 6) AS avg_pred, arg_min(y_pred, abs(y_pred - y_true) * 1000 + variant_id) AS best_pred FROM pr GROUP BY 1")(
    lambda s, d: metrics.by_graph(_pred(s, d)).select("graph_id", "y_true", F.round("y_pred", 6).alias("avg_pred")).join(metrics.by_graph(_pred(s, d), "best").select("graph_id", F.col("y_pred").alias("best_pred")), "graph_id"))
query("O-EV2", _PROBS + ", av AS (SELECT graph_id, y_true, k, avg(p) AS p FROM pv GROUP BY ALL) SELECT graph_id, y_true, k AS y_pred FROM av QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY p DESC, k) = 1")(lambda s, d: metrics.classes_by_graph(_probs(s, d)))
query("O-EV2_best", _PROBS + ", c AS (SELECT graph_id, variant_id, y_true, k AS c FROM pv QUALIFY row_number() OVER (PARTITION BY graph_id, variant_id ORDER BY p DESC, k) = 1), v AS (SELECT graph_id, y_true, c, COUNT(*) AS n FROM c GROUP BY ALL) SELECT graph_id, y_true, coalesce(max(CASE WHEN c = y_true THEN c END), arg_max(c, n * 10 - c)) AS y_pred FROM v GROUP BY 1, 2")(lambda s, d: metrics.classes_by_graph(_probs(s, d), "best"))
query("O-EV3", _PROBS + "SELECT graph_id, k, round(avg(p), 6) AS p FROM pv GROUP BY 1, 2")(lambda s, d: metrics.mean_probs(_probs(s, d)).select("graph_id", F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 6)))
_TRUE = "CASE WHEN (graph_id + k) % 2 = 0 THEN 1.0 ELSE 0.0 END"
_SCALED = _PROBS.rstrip() + f", lb AS (SELECT graph_id, variant_id, k, p / 12 AS p, {_TRUE} AS y FROM pv)"
_multi = lambda s, d: _probs(s, d).select("graph_id", "variant_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when((F.col("graph_id") + k) % 2 == 0, 1.0).otherwise(0.0)).alias("y_true"), F.transform("probs", lambda p: p / 12).alias("probs"))
query("O-EV3_best", _SCALED + ", e AS (SELECT graph_id, variant_id, sum(abs(p - y)) / 3 AS d FROM lb GROUP BY 1, 2), b AS (SELECT graph_id, variant_id FROM e QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY round(d, 9), variant_id) = 1) SELECT graph_id, k, round(p, 6) AS p, CAST(y AS INT) AS y FROM lb JOIN b USING (graph_id, variant_id)")(
    lambda s, d: metrics.labels_by_graph(_multi(s, d), "best").select("graph_id", "y_true", F.posexplode("probs").alias("k", "p")).select("graph_id", "k", F.round("p", 6).alias("p"), F.get("y_true", F.col("k")).cast("int").alias("y")))
query("O-EV4", PRED + ", e AS (SELECT *, exp(variant_id - max(variant_id) OVER (PARTITION BY graph_id)) AS w FROM pr) SELECT graph_id, any_value(y_true) AS y_true, round(sum(w * y_pred) / sum(w), 6) AS y_pred FROM e GROUP BY 1")(lambda s, d: six(metrics.weighted_mean(_pred(s, d), "variant_id"), "y_pred"))
query("O-EV5", PRED + ", n AS (SELECT graph_id, COUNT(*) AS used, list(y_pred ORDER BY variant_id) AS p FROM pr GROUP BY 1), m AS (SELECT CAST(max(used) AS INT) AS k FROM n) SELECT graph_id, k, array_to_string(list_transform(list_concat(p, list_transform(range(k - used), lambda i: 0.0)), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ' ') AS preds, repeat('1', CAST(used AS INT)) || repeat('0', CAST(k - used AS INT)) AS mask FROM n, m")(
    lambda s, d: metrics.variant_sets(_pred(s, d)).select("graph_id", F.size("preds").alias("k"), F.array_join(F.transform("preds", lambda x: x.cast("int")), " ").alias("preds"), F.array_join("mask", "").alias("mask")))
query("O-EV6", PRED + "SELECT COUNT(*) AS n, round(avg((y_true - y_pred) ** 2), 6) AS mse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(corr(y_true, y_pred), 6) AS corr, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(1 - avg((y_true - y_pred) ** 2) / var_pop(y_true), 6) AS r2 FROM pr")(lambda s, d: six(metrics.regression(_pred(s, d)), "mse", "mae", "corr", "rmse", "r2"))
query("O-EV7", CLS + ", k AS (SELECT CAST(range AS INT) AS c FROM range(3)), m AS (SELECT c, COUNT(*) FILTER (y_true = c) AS t, COUNT(*) FILTER (y_pred = c) AS p, COUNT(*) FILTER (y_true = c AND y_pred = c) AS tp FROM k CROSS JOIN pc GROUP BY 1) SELECT CAST(sum(t) AS BIGINT) AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(tp / p), 6) AS precision, round(avg(tp / t), 6) AS recall, round(avg(2 * (tp / p) * (tp / t) / (tp / p + tp / t)), 6) AS f1 FROM m")(
    lambda s, d: six(metrics.classification(_cls(s, d)), "accuracy", "precision", "recall", "f1"))
_RANK = ", g AS (SELECT score, sum(y) AS pos, COUNT(*) AS n FROM pc GROUP BY 1), w AS (SELECT *, sum(n - pos) OVER (ORDER BY score) - (n - pos) AS below, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM g) SELECT round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc, round(sum(pos * tp / seen) / sum(pos), 6) AS ap FROM w"
query("O-EV8", CLS + _RANK)(lambda s, d: six(metrics.ranking(_cls(s, d)), "roc_auc", "ap"))
# Three classes, each against the rest.
query("O-EV8_classes", _PROBS + ", pc AS (SELECT k, CAST(y_true = k AS INT) AS y, p AS score FROM pv), g AS (SELECT k, score, sum(y) AS pos, COUNT(*) AS n FROM pc GROUP BY 1, 2), w AS (SELECT *, sum(n - pos) OVER (PARTITION BY k ORDER BY score) - (n - pos) AS below, sum(pos) OVER (PARTITION BY k ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY score DESC) AS seen FROM g), r AS (SELECT k, sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)) AS roc_auc, sum(pos * tp / seen) / sum(pos) AS ap FROM w GROUP BY 1) SELECT round(avg(roc_auc), 6) AS roc_auc, round(avg(ap), 6) AS ap FROM r")(
    lambda s, d: six(metrics.class_ranking(_probs(s, d)), "roc_auc", "ap"))
_LABELS = CLS.rstrip() + ", l AS (SELECT 0 AS k, y, score FROM pc UNION ALL SELECT 1, CAST(y_true = 1 AS INT), 1 - score FROM pc)"
query("O-EV9", _LABELS + ", m AS (SELECT k, COUNT(*) FILTER (score > 0.5 AND y = 1) AS tp, COUNT(*) FILTER (score > 0.5) AS p, sum(y) AS t, avg(CAST((score > 0.5) = (y = 1) AS INT)) AS h FROM l GROUP BY 1), g AS (SELECT k, score, sum(y) AS pos, COUNT(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER (PARTITION BY k ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY score DESC) AS seen FROM g), a AS (SELECT avg(ap) AS ap FROM (SELECT k, sum(pos * tp / seen) / sum(pos) AS ap FROM w GROUP BY 1)) SELECT round(avg(tp / p), 6) AS precision, round(avg(tp / t), 6) AS recall, round(avg(2 * tp / (p + t)), 6) AS f1, round(avg(h), 6) AS hamming, round(any_value(ap), 6) AS ap FROM m, a")(
    lambda s, d: six(metrics.multi_label(_cls(s, d).select(F.lit(0).alias("k"), "y", "score").union(_cls(s, d).select(F.lit(1), (F.col("y_true") == 1).cast("int"), 1 - F.col("score")))), "precision", "recall", "f1", "hamming", "ap"))
query("O-EV10", PRED + ", t AS (SELECT variant_id % 2 AS k, avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred) ** 2) AS mse, 1 - avg((y_true - y_pred) ** 2) / var_pop(y_true) AS r2, corr(y_true, y_pred) AS corr FROM pr GROUP BY 1) SELECT round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(sqrt(avg(mse)), 6) AS rmse, round(avg(r2), 6) AS r2, round(avg(corr), 6) AS corr FROM t")(
    lambda s, d: six(metrics.multi_target(_pred(s, d).withColumn("k", F.col("variant_id") % 2)), "mae", "mse", "rmse", "r2", "corr"))
_TASKS = ("mlm", "regression", "multi_target_regression", "binary_classification", "classification", "multi_label_classification", "other")
_TASK = "CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TASKS)) + " END"
query("O-EV11", f"SELECT o_orderkey, CASE WHEN task = 'classification' AND dataset = 'molhiv' THEN 'roc_auc' WHEN task IN ('regression', 'multi_target_regression') THEN 'mae' WHEN task = 'binary_classification' THEN 'roc_auc' WHEN task = 'classification' THEN 'accuracy' WHEN task = 'multi_label_classification' THEN 'ap' ELSE 'loss' END AS metric, task IN ('binary_classification', 'classification', 'multi_label_classification') AS maximise FROM (SELECT o_orderkey, {_TASK} AS task, CASE WHEN o_custkey % 2 = 0 THEN 'molhiv' ELSE o_orderpriority END AS dataset FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_TASK).alias("task"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'molhiv' ELSE o_orderpriority END").alias("dataset")).select("o_orderkey", *[c.alias(n) for c, n in zip(metrics.primary("task", "dataset"), ("metric", "maximise"))]))
query("O-EV12", _PROBS + ", e AS (SELECT graph_id, variant_id, k, exp(p - max(p) OVER (PARTITION BY graph_id, variant_id)) AS e FROM pv) SELECT graph_id, variant_id, k, round(e / sum(e) OVER (PARTITION BY graph_id, variant_id), 6) AS p FROM e")(
    lambda s, d: _probs(s, d).select("graph_id", "variant_id", F.posexplode(metrics.softmax(F.col("probs"))).alias("k", "p")).withColumn("p", F.round("p", 6)))
query("O-EV13", "SELECT round(exp(avg(CASE WHEN label <> -100 THEN nll END)), 6) AS perplexity FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN -100 ELSE 1 END AS label, (doc_id % 17) / 10 AS nll FROM documents)")(
    lambda s, d: six(metrics.perplexity(table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, -100).otherwise(1).alias("label"), (F.col("doc_id") % 17 / 10).alias("nll"))), "perplexity"))
query("O-EV14", "WITH x AS (SELECT label AS graph_id, vec_id AS pos, CAST(vec_id % 2 AS INT) AS mask, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS v FROM embeddings) SELECT graph_id, CAST(k AS INT) AS k, round(avg(CASE WHEN mask = 1 THEN CAST(v AS DOUBLE) END), 6) AS mean, round(CAST(arg_min(v, pos) AS DOUBLE), 6) AS cls FROM x GROUP BY 1, 2")(
    lambda s, d: six(metrics.pooled(table(s, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 2).alias("mask"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))), "mean", "cls"))
query("O-EV15", "WITH e AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice AS v FROM orders), i AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM e b WHERE b.run_id = e.run_id AND b.epoch < e.epoch AND b.v >= e.v) AS better FROM e), l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS since FROM i), s AS (SELECT run_id, min(epoch) FILTER (epoch - since >= 3) AS stop FROM l GROUP BY 1), k AS (SELECT l.*, stop FROM l JOIN s USING (run_id) WHERE stop IS NULL OR epoch <= stop) SELECT run_id, max(v) AS best, arg_max(epoch, since) FILTER (better) AS best_epoch, coalesce(any_value(stop), -1) AS stop_epoch FROM k GROUP BY 1")(
    lambda s, d: metrics.stopped(table(s, d, "orders").select(F.col("o_custkey").alias("run_id"), F.expr("row_number() over (partition by o_custkey order by o_orderkey)").alias("epoch"), F.col("o_totalprice").alias("value")), 3).withColumn("stop_epoch", F.coalesce("stop_epoch", F.lit(-1))))
_LOSS = "WITH x AS (SELECT doc_id, CAST(doc_id * 11 % 2 AS INT) AS y, (doc_id * 37 % 99 + 1) / 101 AS p FROM documents), t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt FROM x) "
_losses = lambda s, d: table(s, d, "documents").select("doc_id", (F.col("doc_id") * 11 % 2).cast("int").alias("y"), ((F.col("doc_id") * 37 % 99 + 1) / 101).alias("p"))
query("O-EV16", _LOSS + "SELECT doc_id, round(-ln(pt), 6) AS ce, round(CASE WHEN y = 1 THEN 3 ELSE 0.5 END * -ln(pt), 6) AS weighted_ce, round((1 - pt) * (1 - pt) * -ln(pt), 6) AS focal, round((y - p) ** 2, 6) AS l2, round(abs(y - p), 6) AS l1 FROM t")(
    lambda s, d: six(metrics.losses(_losses(s, d), (0.5, 3.0)).drop("y", "p"), "ce", "weighted_ce", "focal", "l2", "l1"))
# Two passes of one model that agree but for noise, and two rows mixed.
query("O-EV16_pairs", _LOSS + "SELECT doc_id, round(((p - q) * (ln(p) - ln(q)) + (q - p) * (ln(1 - p) - ln(1 - q))) / 2, 6) AS kl, round(0.3 * p + 0.7 * q, 6) AS mixed FROM (SELECT *, (p + 0.5) / 2 AS q FROM t)")(
    lambda s, d: (lambda a, b: six(_losses(s, d).select("doc_id", metrics.two_way_kl(a, b).alias("kl"), metrics.mixup(a, b, F.lit(0.3))[0].alias("mixed")), "kl", "mixed"))(F.array("p", 1 - F.col("p")), F.array((F.col("p") + 0.5) / 2, 1 - (F.col("p") + 0.5) / 2)))
_gauss = lambda what: f"CAST('0x' || substr(md5(doc_id || ':42:{what}'), 1, 12) AS BIGINT) / {float(1 << 48)}"
query("O-EV16_logits", _LOSS + f"SELECT doc_id, round(CASE WHEN y = 1 THEN ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END, 6) AS bce, round(p + 0.1 * sqrt(-2 * ln(greatest({_gauss('a')}, 1e-12))) * cos(2 * pi() * {_gauss('b')}), 6) AS noisy FROM (SELECT *, ln(p / (1 - p)) AS x FROM t)")(
    lambda s, d: six(_losses(s, d).withColumn("x", F.log(F.col("p") / (1 - F.col("p")))).select("doc_id", metrics.bce_with_logits("x", "y").alias("bce"), metrics.noisy("p", 0.1, "doc_id").alias("noisy")), "bce", "noisy"))
# A run a user, a step an event; a tenth of the steps are warm-up.
query("O-EV17", EVENTS + ", n AS (SELECT graph_id, pos, COUNT(*) OVER (PARTITION BY graph_id) AS steps FROM ev), w AS (SELECT *, steps // 10 AS warm FROM n) SELECT graph_id, pos, round(CASE WHEN pos < warm THEN (pos + 1) / warm ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * (pos - warm) / greatest(1, steps - warm))) END, 6) AS factor FROM w")(
    lambda s, d: views.user_events(s, d).withColumn("steps", F.count("*").over(W.partitionBy("graph_id"))).select("graph_id", "pos", F.round(metrics.schedule("pos", "steps", F.floor(F.col("steps") / 10)), 6).alias("factor")))

# Splits
_ids = lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("graph_id"), "lang")
_PLACE = "CASE WHEN k < floor(n * 0.8 + 1e-9) THEN 'train' WHEN k < floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split"
_KEY = "(doc_id * 7919 + 42 * 104729) % 1000003"
query("O-SP1", f"SELECT doc_id AS graph_id, {_PLACE} FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, COUNT(*) OVER () AS n FROM documents)")(lambda s, d: splits.placed(_ids(s, d), "graph_id").select("graph_id", "split"))
query("O-SP2", f"SELECT doc_id AS graph_id, lang, {_PLACE} FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) - 1 AS k, COUNT(*) OVER (PARTITION BY lang) AS n FROM documents)")(lambda s, d: splits.stratified(_ids(s, d), "lang"))
query("O-SP3", f"SELECT doc_id AS graph_id, {_PLACE} FROM (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS k, COUNT(*) OVER () AS n FROM documents)")(lambda s, d: splits.shuffled(_ids(s, d)).select("graph_id", "split"))
query("O-SP4", f"SELECT doc_id AS graph_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM (SELECT doc_id FROM documents ORDER BY {_KEY}, doc_id LIMIT 50)")(lambda s, d: splits.drawn(_ids(s, d), 50).select("graph_id", "new_id"))
query("O-SP5", "WITH s AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT doc_id + 1000000 FROM documents WHERE doc_id % 13 = 1) SELECT (SELECT COUNT(*) FROM s) AS rows, (SELECT COUNT(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING COUNT(*) > 1)) AS twice, (SELECT COUNT(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown")(
    lambda s, d: splits.faults((lambda x: x.union(x.filter("graph_id % 9 = 4")).union(x.filter("graph_id % 13 = 1").withColumn("graph_id", F.col("graph_id") + 1000000)))(splits.placed(_ids(s, d), "graph_id")), _ids(s, d)))
query("O-SP7", "SELECT doc_id AS graph_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM documents")(
    lambda s, d: splits.given(_ids(s, d).select("graph_id"), {k: _ids(s, d).filter(F.col("graph_id") % 4 == m).select("graph_id") for m, k in enumerate(("train", "valid", "test"))}))
query("O-SP6", EVENTS + f", u AS (SELECT DISTINCT graph_id AS doc_id FROM ev), sp AS (SELECT doc_id, {_PLACE} FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, COUNT(*) OVER () AS n FROM u)) SELECT graph_id, COUNT(*) AS n FROM ev JOIN sp ON doc_id = graph_id WHERE split = 'train' GROUP BY 1")(
    lambda s, d: splits.of_split(_seqs(s, d), splits.placed(_seqs(s, d).select("graph_id"), "graph_id"), "train").select("graph_id", F.size("tokens").cast("long").alias("n")))

# Streams, over the events table, as batches: tests hold them against the stream
query("O-ST1", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")(lambda s, d: streaming.counts(table(s, d, "events"), "event_type").withColumnRenamed("cnt", "n"))
query("O-ST1_windows", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: streaming.tumbling(table(s, d, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "n"))
query("O-ST1_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 + 1800 AS seconds, COUNT(*) AS n FROM s GROUP BY user_id, k")(
    lambda s, d: streaming.sessions(table(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), F.timestamp_diff("SECOND", "start", "end").alias("seconds"), "n"))
# Sessions as sequences, from the stream: those that the watermark has closed.
_SESSION = "WITH g AS (SELECT DISTINCT ON (event_id) event_id, user_id, ts, event_type FROM events), f AS (SELECT *, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER w) < 1800000 THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f), x AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, max(ts) AS last, string_agg(CASE event_type WHEN 'click' THEN '0' WHEN 'error' THEN '1' WHEN 'purchase' THEN '2' WHEN 'signup' THEN '3' ELSE '4' END, ' ' ORDER BY ts, event_id) AS tokens FROM s GROUP BY user_id, k) "
_shown = lambda df: df.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), F.array_join("tokens", " ").alias("tokens"))
query("O-ST2", _SESSION + "SELECT user_id, first, tokens FROM x WHERE last + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'")(
    lambda s, d: _shown(streaming.written(streaming.session_sequences(streaming.read(s, d, streaming.EVENTS, "events.parquet")), io.scratch(s, "sessions"))))
query("O-ST2_table", _SESSION + "SELECT user_id, first, tokens FROM x")(lambda s, d: _shown(streaming.session_sequences_of(table(s, d, "events"))))
