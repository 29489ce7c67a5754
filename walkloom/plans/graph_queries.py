"""Queries over the customer graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.operators import graph as G
from walkloom.operators import large_graph, stats, walks
from walkloom.operators import tokenize as T
from walkloom.plans.views_sql import BFS, COMPONENTS, GRAPH, RECURSIVE
from walkloom.sources import io, views

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _w(spark, d):
    e = views.edges(spark, d)
    return G.weighted(e, G.triplets(e))


def _packed(spark, d, counts=False):
    if not counts:
        return views.packed(spark, d)
    e = views.edges(spark, d)
    return views.packed_edges(e, G.triplets(e))


query("O-SC1", GRAPH + "SELECT n.graph_id, n.num_nodes, e.num_edges FROM (SELECT graph_id, COUNT(*) AS num_nodes FROM nodes GROUP BY 1) n JOIN (SELECT graph_id, COUNT(*) AS num_edges FROM edges GROUP BY 1) e USING (graph_id)")(
    lambda s, d: views.nodes(s, d).groupBy("graph_id").agg(F.count("*").alias("num_nodes")).join(views.edges(s, d).groupBy("graph_id").agg(F.count("*").alias("num_edges")), "graph_id"))
query("O-SC2", GRAPH + "SELECT graph_id, edge_id, src, dst, edge_type FROM edges")(
    lambda s, d: io.unpack(_packed(s, d))[1].select("graph_id", "edge_id", "src", "dst", "edge_type"))
query("O-SK4", GRAPH + "SELECT graph_id, CAST(list(src ORDER BY edge_id) AS VARCHAR) AS src, CAST(list(dst ORDER BY edge_id) AS VARCHAR) AS dst FROM edges GROUP BY 1")(
    lambda s, d: _packed(s, d).select("graph_id", *[F.concat(F.lit("["), F.array_join(F.transform("edges", lambda e: e[c]), ", "), F.lit("]")).alias(c) for c in ("src", "dst")]))
query("O-SK7", GRAPH + """, j AS (SELECT sha256(to_json({'dst': dst, 'dst_type': dst_type, 'edge_id': edge_id, 'edge_type': edge_type, 'graph_id': graph_id, 'src': src, 'src_type': src_type})) AS h FROM edges) SELECT COUNT(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS total FROM j""")(lambda s, d: io.digest(views.edges(s, d)))
_changed = lambda e: e.withColumn("edge_type", F.when(F.col("graph_id") % 7 == 0, F.col("edge_type") + 1).otherwise(F.col("edge_type"))).filter("graph_id % 11 <> 0 or edge_id > 2")
query("O-SK7_differences", GRAPH + ", b AS (SELECT graph_id, edge_id, src, dst, CASE WHEN graph_id % 7 = 0 THEN edge_type + 1 ELSE edge_type END AS edge_type FROM edges WHERE graph_id % 11 <> 0 OR edge_id > 2), a AS (SELECT graph_id, edge_id, src, dst, edge_type FROM edges), oa AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), ob AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) SELECT (SELECT COUNT(*) FROM a) AS rows_a, (SELECT COUNT(*) FROM b) AS rows_b, (SELECT COUNT(*) FROM oa) AS only_a, (SELECT COUNT(*) FROM ob) AS only_b, (SELECT COUNT(*) FROM oa) + (SELECT COUNT(*) FROM ob) = 0 AS same")(
    lambda s, d: (lambda e: io.compare(e, _changed(e)))(views.edges(s, d).select("graph_id", "edge_id", "src", "dst", "edge_type")))
query("O-PF3", GRAPH + "SELECT graph_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_id) UNION ALL SELECT graph_id, CAST(-1 AS INT) FROM edges WHERE src = dst")(
    lambda s, d: views.nodes(s, d).join(views.edges(s, d).select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id").union(views.edges(s, d).filter("src = dst").select("graph_id", F.lit(-1))))
query("O-PF4", GRAPH + "SELECT graph_id, node_id, 2 * node_type + 1 AS feat FROM nodes")(
    lambda s, d: views.nodes(s, d).select("graph_id", "node_id", T.node_token("node_type").alias("feat")))
query("O-PF7", GRAPH + "SELECT DISTINCT graph_id FROM nodes ORDER BY graph_id LIMIT 20")(
    lambda s, d: views.nodes(s, d).select("graph_id").distinct().orderBy("graph_id").limit(20))
query("O-TK1", GRAPH + "SELECT graph_id, edge_id, 2 * src_type + 1 AS src_token, 2 * edge_type AS token, edge_type AS back FROM edges")(
    lambda s, d: views.edges(s, d).select("graph_id", "edge_id", T.node_token("src_type").alias("src_token"), T.edge_token("edge_type").alias("token"), T.token_type(T.edge_token("edge_type")).alias("back")))
query("O-TK2", GRAPH + "SELECT graph_id, node_id, 2 * node_type + 1 AS a, 2 * kind + 1 + 1000000 AS b FROM nodes")(
    lambda s, d: views.nodes(s, d).withColumn("t", T.two_channels("node_type", "kind")).select("graph_id", "node_id", F.col("t")[0].alias("a"), F.col("t")[1].alias("b")))
query("O-TK3", GRAPH + "SELECT graph_id, 'node' AS kind, node_id AS id, CASE WHEN max(CASE WHEN node_type % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id) = 1 THEN 2 * node_type + 1 ELSE node_type END AS token FROM nodes UNION ALL SELECT graph_id, 'edge' AS kind, edge_id AS id, CASE WHEN max(CASE WHEN edge_type % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id) = 1 THEN 2 * edge_type ELSE edge_type END AS token FROM edges")(
    lambda s, d: T.repaired_features(views.edges(s, d)))
query("O-TK6", GRAPH + "SELECT graph_id, node_id, CAST(dense_rank() OVER (ORDER BY kind, node_type) - 1 AS INT) AS type_id FROM nodes")(
    lambda s, d: T.dense_ids(views.nodes(s, d), ["kind", "node_type"]).select("graph_id", "node_id", "type_id"))
query("O-TK7", GRAPH + "SELECT graph_id, edge_id, CAST(src_type AS BIGINT) * CAST(dst_type AS BIGINT) AS t FROM edges")(
    lambda s, d: views.edges(s, d).select("graph_id", "edge_id", T.product_type("src_type", "dst_type").alias("t")))
query("O-TK8", GRAPH + "SELECT graph_id, edge_id, CASE edge_type WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS code FROM edges")(
    lambda s, d: views.edges(s, d).select("graph_id", "edge_id", T.bond_code("edge_type").alias("code")))
query("O-TK11", BFS + "SELECT graph_id, string_agg(coalesce((SELECT sym FROM (VALUES " + ", ".join(f"({2 * z + 1}, '{x}')" for z, x in T.SYMBOLS.items()) + ") v(t, sym) WHERE v.t = tok), '?'), '' ORDER BY key) AS text FROM walk GROUP BY 1")(lambda s, d: walks.serialize(_packed(s, d), "bfs", elements=False).select("graph_id", T.readable("tokens").alias("text")))
query("O-TK12", GRAPH + "SELECT DISTINCT 'node' AS kind, node_type AS value, CAST(2 * node_type + 1 AS INT) AS token FROM nodes UNION ALL SELECT DISTINCT 'edge', CAST(edge_type AS INT), CAST(2 * edge_type AS INT) FROM edges")(lambda s, d: T.token_map(views.nodes(s, d), views.edges(s, d)))
query("O-GS1", GRAPH + "SELECT * FROM tri")(lambda s, d: G.triplets(views.edges(s, d)))
query("O-GS2", GRAPH + "SELECT (SELECT max(node_type) + 1 FROM nodes) AS node_types, (SELECT max(edge_type) + 1 FROM edges) AS edge_types")(lambda s, d: G.type_space(views.edges(s, d), views.nodes(s, d)))
query("O-GS3", GRAPH + "SELECT CAST(a.range AS INT) AS src_type, CAST(b.range AS INT) AS edge_type, CAST(c.range AS INT) AS dst_type, coalesce(cnt, 0) AS cnt FROM range(16) a, range(4) b, range(16) c LEFT JOIN tri ON src_type = a.range AND edge_type = b.range AND dst_type = c.range")(
    lambda s, d: G.dense_triplets(s, G.triplets(views.edges(s, d)), 16, 4))
query("O-GS4", GRAPH + "SELECT t AS triplet, CAST(SUM(cnt) AS BIGINT) AS cnt FROM (SELECT src_type || '-' || edge_type || '-' || dst_type AS t, cnt FROM tri UNION ALL SELECT dst_type || '-' || edge_type || '-' || src_type, cnt FROM tri) GROUP BY 1")(
    lambda s, d: G.symmetric_triplets(views.edges(s, d)))
query("O-GS5", GRAPH + "SELECT graph_id, edge_id, round(weight, 6) AS weight FROM wt")(lambda s, d: six(_w(s, d).select("graph_id", "edge_id", "weight"), "weight"))
query("O-GS6", GRAPH + ", mm AS (SELECT *, min(weight) OVER (PARTITION BY graph_id) AS lo, max(weight) OVER (PARTITION BY graph_id) AS hi FROM wt) SELECT graph_id, edge_id, round(0.5 + 0.5 * (1 - CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 0.5 END), 6) AS cost FROM mm")(
    lambda s, d: six(G.edge_costs(_w(s, d)).select("graph_id", "edge_id", "cost"), "cost"))
query("O-GS7", GRAPH + "SELECT min(cnt) AS lo, max(cnt) AS hi, COUNT(*) AS nonzero FROM tri")(lambda s, d: G.triplet_summary(G.triplets(views.edges(s, d))))
query("O-GS8", COMPONENTS + "SELECT graph_id, node_id, root, rank FROM comp")(lambda s, d: G.components(_packed(s, d)))
query("O-GS9", COMPONENTS + "SELECT graph_id, max(rank) = 0 AS connected FROM comp GROUP BY 1")(lambda s, d: G.components(_packed(s, d)).groupBy("graph_id").agg((F.max("rank") == 0).alias("connected")))
query("O-GS10", GRAPH + "SELECT graph_id, edge_id, src, dst FROM edges WHERE src < dst")(lambda s, d: G.undirected(views.edges(s, d)).select("graph_id", "edge_id", "src", "dst"))
query("O-GS11", GRAPH + "SELECT graph_id, src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM edges GROUP BY 1, 2")(
    lambda s, d: G.adjacency(views.edges(s, d)).withColumn("neighbours", F.array_join("neighbours", ",")))
query("O-GS12", GRAPH + "SELECT graph_id, n, e, round(avg_degree, 6) AS avg_degree, max_degree, min_degree, degree_sequence, round(CASE WHEN n > 1 THEN e / (n * (n - 1) / 2.0) ELSE 0 END, 6) AS density FROM (SELECT graph_id, COUNT(*) AS n, CAST(SUM(degree) / 2 AS BIGINT) AS e, avg(degree) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree, string_agg(CAST(degree AS VARCHAR), ',' ORDER BY degree DESC) AS degree_sequence FROM deg GROUP BY 1)")(
    lambda s, d: six(G.summary(views.nodes(s, d), views.edges(s, d)), "avg_degree", "density").withColumn("degree_sequence", F.array_join("degree_sequence", ",")))
query("O-GS13", COMPONENTS + ", c AS (SELECT graph_id, max(rank) = 0 AS connected FROM comp GROUP BY 1), m AS (SELECT graph_id, COUNT(*) AS n, min(degree) AS least FROM deg GROUP BY 1), ore AS (SELECT DISTINCT a.graph_id FROM deg a JOIN deg b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN m ON m.graph_id = a.graph_id WHERE a.degree + b.degree < m.n AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = a.graph_id AND e.src = a.node_id AND e.dst = b.node_id)) SELECT graph_id, connected AND (least >= n // 2 OR ore.graph_id IS NULL) AS verdict, CASE WHEN NOT connected THEN 'unconnected' WHEN least >= n // 2 THEN 'dirac' WHEN ore.graph_id IS NULL THEN 'ore' ELSE 'neither' END AS why FROM c JOIN m USING (graph_id) LEFT JOIN ore USING (graph_id)")(
    lambda s, d: G.hamiltonian_screen(_packed(s, d)))


def _walk_weights(s, d):
    """Whole walks as paths: an Euler walk uses each edge once; where a graph has several parts, no edge joins these. Packed graphs are written once, for the counts and the walks."""
    packed = io.saved(_packed(s, d), "packed")
    return G.walk_weight(packed, G.packed_triplets(packed))


query("O-GS13_weight", COMPONENTS + ", c AS (SELECT graph_id, max(rank) = 0 AS connected FROM comp GROUP BY 1), t AS (SELECT graph_id, sum(weight) AS total, COUNT(*) AS n FROM wt GROUP BY 1) SELECT graph_id, n + 1 AS nodes, CASE WHEN connected THEN round(total, 6) ELSE -1 END AS total FROM c JOIN t USING (graph_id) WHERE connected UNION ALL SELECT graph_id, n + parts AS nodes, -1 FROM t JOIN (SELECT graph_id, max(rank) + 1 AS parts FROM comp GROUP BY 1) USING (graph_id) WHERE parts > 1")(
    lambda s, d: _walk_weights(s, d).select("graph_id", F.size("path").cast("long").alias("nodes"), F.when(F.col("total") < float("inf"), F.round("total", 6)).otherwise(-1.0).alias("total")))


def _rings(s, d):
    """nodes, edges and paths of customers' orders: a ring of its orders in order of key; of a third of the customers it doesn't close, of a third the path leaves out its last node; all paths also closed and turned."""
    o = views.table(s, d, "orders").select(F.col("o_custkey").alias("graph_id"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("node_id"))
    n = o.groupBy("graph_id").agg(F.count("*").cast("int").alias("n")).filter("n >= 3")
    nodes = o.join(n, "graph_id")
    step = nodes.select("graph_id", F.col("node_id").alias("a"), ((F.col("node_id") + 1) % F.col("n")).alias("b"), "n").filter("graph_id % 3 <> 0 or a + 1 < n")
    edges = step.select("graph_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("graph_id", "e.*").distinct()
    whole = F.sequence(F.lit(0), F.col("n") - 1 - (F.col("graph_id") % 3 == 1).cast("int"))
    paths = n.select("graph_id", F.explode(F.array(F.struct(F.lit("open").alias("how"), whole.alias("path")), F.struct(F.lit("closed").alias("how"), F.concat(whole, F.array(F.lit(0))).alias("path")), F.struct(F.lit("turned").alias("how"), F.concat(F.slice(whole, 2, F.size(whole) - 1), F.array(F.lit(0))).alias("path")))).alias("p")).select("graph_id", "p.*")
    return nodes, edges, paths


def _valid(s, d):
    nodes, edges, paths = _rings(s, d)
    return G.path_validity(paths.select("graph_id", "path"), nodes, edges).join(paths, ["graph_id", "path"]).select("graph_id", "how", "is_path", "is_cycle")


query("O-GS13_validity", "WITH n AS (SELECT o_custkey AS graph_id, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 3) SELECT graph_id, how, graph_id % 3 <> 1 AND (how = 'open' OR how = 'turned' AND graph_id % 3 = 2) AS is_path, graph_id % 3 = 2 AS is_cycle FROM n, (VALUES ('open'), ('closed'), ('turned')) h(how)")(_valid)
_HOPS = RECURSIVE + """, hop(graph_id, s, v, d) USING KEY (graph_id, s, v) AS (SELECT graph_id, node_id, node_id, 0 FROM deg WHERE degree % 2 = 1 UNION SELECT x.graph_id, x.s, x.v, x.d FROM (SELECT h.graph_id, h.s, e.dst AS v, min(h.d) + 1 AS d FROM hop h JOIN edges e ON e.graph_id = h.graph_id AND e.src = h.v GROUP BY 1, 2, 3) x LEFT JOIN recurring.hop r ON r.graph_id = x.graph_id AND r.s = x.s AND r.v = x.v WHERE r.d IS NULL)"""
query("O-GS15", _HOPS + " SELECT h.graph_id, COUNT(*) AS paths, CAST(sum(d) AS BIGINT) AS hops, CAST(max(d) AS BIGINT) AS longest FROM hop h JOIN deg ON deg.graph_id = h.graph_id AND deg.node_id = h.v AND deg.degree % 2 = 1 WHERE h.v > h.s GROUP BY 1")(
    lambda s, d: walks.odd_paths(_packed(s, d)).groupBy("graph_id").agg(F.count("*").alias("paths"), F.sum("hops").alias("hops"), F.max("hops").alias("longest")))
query("O-GS16")(lambda s, d: walks.postman_costs(_packed(s, d)))
query("O-GS16_weighted")(lambda s, d: six(walks.postman_costs(_packed(s, d, True), True), "cost"))
query("O-GS14", GRAPH + "SELECT graph_id, node_id FROM deg WHERE degree % 2 = 1")(lambda s, d: G.odd_nodes(views.edges(s, d)))
query("O-GS17", GRAPH + "SELECT n.graph_id, n.node_types, e.edge_types FROM (SELECT graph_id, COUNT(DISTINCT node_type) AS node_types FROM nodes GROUP BY 1) n JOIN (SELECT graph_id, COUNT(DISTINCT edge_type) AS edge_types FROM edges GROUP BY 1) e USING (graph_id)")(
    lambda s, d: G.type_counts(views.nodes(s, d), views.edges(s, d)))
_wl = GRAPH + ", l0 AS (SELECT graph_id, node_id, md5(CAST(node_type AS VARCHAR)) AS label FROM nodes)"
for _k in range(3):
    _wl += f", l{_k + 1} AS (SELECT v.graph_id, v.node_id, md5(concat_ws('/', any_value(v.label), coalesce(string_agg(e.edge_type || ':' || u.label, '|' ORDER BY e.edge_type || ':' || u.label), ''))) AS label FROM l{_k} v LEFT JOIN edges e ON e.graph_id = v.graph_id AND e.src = v.node_id LEFT JOIN l{_k} u ON u.graph_id = e.graph_id AND u.node_id = e.dst GROUP BY 1, 2)"
query("O-GS18", _wl + " SELECT graph_id, md5(string_agg(label, '|' ORDER BY label)) AS wl FROM l3 GROUP BY 1")(lambda s, d: G.wl_hash(_packed(s, d)))
_SIG = GRAPH + ", t AS (SELECT graph_id, string_agg(CAST(node_type AS VARCHAR), ',' ORDER BY node_id) AS t FROM nodes GROUP BY 1), u AS (SELECT graph_id, string_agg(src || '-' || dst || '-' || edge_type, ',' ORDER BY edge_id) AS u FROM edges GROUP BY 1), sig AS (SELECT graph_id, md5(t || '|' || u) AS signature FROM t JOIN u USING (graph_id))"
query("O-GS18_signature", _SIG + " SELECT * FROM sig")(lambda s, d: G.signature(_packed(s, d)))
query("O-GS18_reorder", _SIG + ", k AS (SELECT substr(signature, 1, 2) AS signature, graph_id, graph_id * 7919 % 1000003 AS place FROM sig), a AS (SELECT signature, graph_id, row_number() OVER (PARTITION BY signature ORDER BY graph_id) AS n FROM k), b AS (SELECT signature, place, row_number() OVER (PARTITION BY signature ORDER BY place) AS n FROM k WHERE graph_id % 5 <> 0) SELECT a.signature, a.graph_id, coalesce(b.place, -1) AS place FROM a LEFT JOIN b USING (signature, n)")(
    lambda s, d: (lambda k: G.reordered(k, k.filter("graph_id % 5 <> 0").select("signature", (F.col("graph_id") * 7919 % 1000003).alias("place"))))(io.saved(G.signature(_packed(s, d)).withColumn("signature", F.substring("signature", 1, 2)).select("signature", "graph_id"), "signatures")).withColumn("place", F.coalesce("place", F.lit(-1))))
query("O-GS17_histogram", GRAPH + "SELECT graph_id, node_type, COUNT(*) AS cnt FROM nodes GROUP BY 1, 2")(lambda s, d: G.histogram(views.nodes(s, d), "node_type"))
query("O-GS19", GRAPH + "SELECT graph_id, kind, CAST(row_number() OVER (PARTITION BY graph_id, kind ORDER BY k) - 1 AS INT) AS local_id, node_id FROM nodes")(lambda s, d: G.flatten_kinds(views.nodes(s, d)))


def _walked(method, variants=1, omit=1):
    return lambda s, d: walks.serialize(_packed(s, d, method in ("feuler", "fcpp")), method, variants, omit, elements=False).select("graph_id", "variant_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


# Walks whose order SQL can't express have no SQL here; O-SE13, O-SE14 and O-SE17 hold what they use against it.
for _id, _m in (("O-SE1", "feuler"), ("O-SE2", "eulerian"), ("O-SE3", "cpp"), ("O-SE4", "fcpp"), ("O-SE6", "dfs")):
    query(_id)(_walked(_m))
_TOKENS = "CAST(0 AS INT) AS variant_id, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY key) AS tokens, CAST(COUNT(*) AS INT) AS n FROM walk GROUP BY 1"
query("O-SE5", BFS + f"SELECT graph_id, {_TOKENS}")(_walked("bfs"))
# Parts have smaller ids than suppliers, and arcs go from these to those: a part follows the largest of its suppliers.
query("O-SE7", GRAPH + f", walk AS (SELECT n.graph_id, 2 * n.node_type + 1 AS tok, lpad(CAST(CASE WHEN n.kind = 1 THEN n.node_id ELSE (SELECT max(dst) FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_id) END AS VARCHAR), 8, '0') || n.kind * -1 + 1 || lpad(CAST(n.node_id AS VARCHAR), 8, '0') AS key FROM nodes n) SELECT graph_id, {_TOKENS}")(_walked("topo"))


def _uses(method, kind, omit=None):
    """How often a walk comes by each edge or node."""
    return lambda s, d: walks.provenance(walks.serialize(_packed(s, d, True), method, omit=omit)).filter(F.col("kind") == kind).groupBy("graph_id", "id").agg(F.count("*").alias("n"))


query("O-SE13", GRAPH + "SELECT graph_id, edge_id AS id, 1 AS n FROM edges WHERE edge_type <> 1")(_uses("feuler", "edge", 1))
query("O-SE13_eulerian", GRAPH + "SELECT graph_id, edge_id AS id, 1 AS n FROM edges")(_uses("eulerian", "edge"))
# A postman uses each pair of nodes once or twice, in either direction.
query("O-SE13_cpp", GRAPH + "SELECT graph_id, src, dst, true AS once_or_twice FROM edges WHERE src < dst")(
    lambda s, d: _uses("cpp", "edge")(s, d).join(views.edges(s, d).select("graph_id", F.col("edge_id").alias("id"), "src", "dst"), ["graph_id", "id"]).groupBy("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("n").isin(1, 2).alias("once_or_twice")))
query("O-SE14", COMPONENTS + "SELECT graph_id, max(rank) AS separators FROM comp GROUP BY 1")(lambda s, d: walks.serialize(_packed(s, d, True), "feuler").select("graph_id", F.size(F.filter("elements", lambda e: e == "component_sep")).alias("separators")))
_VARIANTS = COMPONENTS + ", n AS (SELECT graph_id, COUNT(*) AS n FROM nodes GROUP BY 1), v AS (SELECT graph_id, n, unnest(range(0, least(4, n))) AS v FROM n), w AS (SELECT graph_id, CAST(v AS INT) AS variant_id, v * greatest(1, n // least(4, n)) % n AS node_id FROM v) SELECT w.graph_id, variant_id, 2 * nodes.node_type + 1 AS first, CAST((SELECT COUNT(*) FROM comp x WHERE x.graph_id = w.graph_id AND x.root = comp.root) AS INT) AS n FROM w JOIN comp ON comp.graph_id = w.graph_id AND comp.node_id = w.node_id JOIN nodes ON nodes.graph_id = w.graph_id AND nodes.node_id = w.node_id"
_variants = lambda s, d: walks.serialize(_packed(s, d), "bfs", 4, elements=False).select("graph_id", "variant_id", F.get("tokens", F.lit(0)).alias("first"), F.size("tokens").alias("n"))
query("O-SE15", _VARIANTS)(_variants)
# All variants of all graphs, in one order.
query("O-SE16", f"SELECT *, row_number() OVER (ORDER BY graph_id, variant_id) - 1 AS place FROM ({_VARIANTS})")(lambda s, d: large_graph.ranked(_variants(s, d), [], ["graph_id", "variant_id"]))
# A node is come by once for each edge from it, and once more where its component's walk begins.
query("O-SE17", COMPONENTS + "SELECT c.graph_id, c.node_id AS id, any_value(degree) + CASE WHEN any_value(root) = c.node_id THEN 1 ELSE 0 END AS n FROM comp c JOIN deg ON deg.graph_id = c.graph_id AND deg.node_id = c.node_id GROUP BY c.graph_id, c.node_id")(_uses("eulerian", "node"))
query("O-SE18", GRAPH + "SELECT edge_type, COUNT(*) AS cnt FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(
    lambda s, d: views.edges(s, d).groupBy("edge_type").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "edge_type").limit(1))
query("O-AG1", GRAPH + ", g AS (SELECT graph_id, COUNT(*) AS n FROM nodes GROUP BY 1) SELECT CASE WHEN graph_id % 10 < 8 THEN 'train' WHEN graph_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, COUNT(n) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS lo, max(n) AS hi, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1")(
    lambda s, d: stats.moments(views.nodes(s, d).groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("split", F.when(F.col("graph_id") % 10 < 8, "train").when(F.col("graph_id") % 10 == 8, "val").otherwise("test")), "n", "split").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)}))

# One graph of all line items, spread over rows.
_WHOLE = """WITH RECURSIVE half AS (SELECT l_partkey AS a, l_suppkey + 1099511627776 AS b, CAST(min(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS BIGINT) AS cost FROM lineitem GROUP BY 1, 2),
e AS (SELECT a AS src, b AS dst, cost FROM half UNION ALL SELECT b, a, cost FROM half)"""


#: Steps of a walk that a block has.
_BLOCK = 10_000


def _tour(s, d):
    """Of the walk of each part of the graph, as found by its order: edges, how many are used once, steps that don't begin where the last ended, and whether it closes."""
    e = io.saved(views.whole_edges(s, d).select("graph_id", "edge_id", "src", "dst"), "edges")
    walk = large_graph.euler(e)
    # Steps are compared to the next in blocks; a block's first step is also the last one's of the block before.
    block = F.floor(F.col("pos") / _BLOCK)
    also = F.when(F.col("pos") % _BLOCK == 0, F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    uses = walk.select("root", "pos", "edge_id", (F.row_number().over(W.partitionBy("edge_id").orderBy("pos")) == 1).alias("once"))
    at = uses.join(e, "edge_id").select("root", "pos", "src", "dst", "once", F.explode(also).alias("x")).select("root", "pos", "src", "dst", "once", "x.*")
    then = at.withColumn("next_src", F.lead("src").over(W.partitionBy("block", "root").orderBy("pos")))
    ends = then.groupBy("root").agg(F.count_if("own").alias("n"), F.count_if(F.col("own") & F.col("once")).alias("used"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min_by("src", "pos").alias("first"), F.max_by("dst", "pos").alias("last"), F.count_if(F.col("next_src") != F.col("dst")).alias("breaks"))
    return ends.agg(F.sum("n").alias("edges"), F.sum("used").alias("used"), F.bool_and((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("whole"), F.bool_and(F.col("first") == F.col("last")).alias("closed"), F.coalesce(F.sum("breaks"), F.lit(0)).alias("breaks"))


query("O-SE1_whole", _WHOLE + " SELECT COUNT(*) AS edges, COUNT(*) AS used, true AS whole, true AS closed, CAST(0 AS BIGINT) AS breaks FROM e")(_tour)
_LEVELS = ", v0 AS (SELECT min(src) AS node_id, 0 AS level, CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS parent FROM e)"
for _k in range(8):
    _seen = " UNION ALL ".join(f"SELECT * FROM v{j}" for j in range(_k + 1))
    _LEVELS += f", v{_k + 1} AS (SELECT dst AS node_id, {_k + 1} AS level, (SELECT COUNT(*) FROM ({_seen})) + row_number() OVER (ORDER BY min(place), dst) - 1 AS place, arg_min(src, place) AS parent FROM e JOIN v{_k} ON src = node_id WHERE dst NOT IN (SELECT node_id FROM ({_seen})) GROUP BY dst)"
query("O-SE5_whole", _WHOLE + _LEVELS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM v{j}" for j in range(9)) + ")")(lambda s, d: large_graph.bfs(views.whole_edges(s, d)).select("node_id", "level", "place", F.coalesce("parent", F.lit(-1)).alias("parent")))
# Suppliers have the larger ids, and arcs go from larger to smaller: a part follows the largest of its suppliers.
query("O-SE7_whole", _WHOLE + ", n AS (SELECT b AS node_id, b AS after, 0 AS kind FROM half UNION SELECT a, max(b), 1 FROM half GROUP BY a) SELECT node_id, row_number() OVER (ORDER BY after, kind, node_id) - 1 AS place FROM n")(
    lambda s, d: (lambda e: large_graph.topo(e.select("graph_id", F.col("src").alias("node_id")), e).select("node_id", "place"))(views.whole_edges(s, d)))
query("O-GS15_whole", _WHOLE + """, dist(node_id, dist) USING KEY (node_id) AS (SELECT min(src), CAST(0 AS BIGINT) FROM e UNION SELECT x.dst, x.d FROM (SELECT e.dst, CAST(min(dist.dist + e.cost) AS BIGINT) AS d FROM dist JOIN e ON e.src = dist.node_id GROUP BY 1) x LEFT JOIN recurring.dist r ON r.node_id = x.dst WHERE r.dist IS NULL OR x.d < r.dist)
SELECT t.node_id, t.dist, coalesce(string_agg(CAST(f.node_id AS VARCHAR), ',' ORDER BY f.node_id), '') AS predecessors FROM dist t LEFT JOIN (SELECT f.node_id, f.dist + e.cost AS d, e.dst FROM dist f JOIN e ON e.src = f.node_id) f ON f.dst = t.node_id AND f.d = t.dist GROUP BY 1, 2""")(
    lambda s, d: (lambda e: large_graph.shortest_paths(e, large_graph.least_nodes(e), 3).select("node_id", "dist", F.array_join("predecessors", ",").alias("predecessors")))(views.whole_edges(s, d)))
