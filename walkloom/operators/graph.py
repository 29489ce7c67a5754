"""Statistics and structure of graphs. edges: graph_id, edge_id, src, dst, src_type, dst_type, edge_type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.sources.io import discard, saved

TRIPLET = ["src_type", "edge_type", "dst_type"]


def triplets(edges: DataFrame) -> DataFrame:
    """src_type, edge_type, dst_type, cnt over all directed edges. Counts are summed before they are shuffled."""
    return edges.groupBy(*TRIPLET).agg(F.count("*").alias("cnt"))


def type_space(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_types, edge_types: largest ids plus one."""
    v = nodes.agg((F.max("node_type") + 1).alias("node_types"))
    return v.crossJoin(edges.agg((F.max("edge_type") + 1).alias("edge_types")))  # one row each


def dense_triplets(spark, counts: DataFrame, node_types: int, edge_types: int) -> DataFrame:
    """counts with zeros for all absent triplets of the type space."""
    if node_types <= 0 or edge_types <= 0:
        raise ValueError("a type space has at least one node and edge type")
    k = F.col("id")
    every = spark.range(node_types * edge_types * node_types).select((k / (edge_types * node_types)).cast("int").alias("src_type"), (k / node_types).cast("int").alias("_e"), (k % node_types).cast("int").alias("dst_type"))
    every = every.select("src_type", (F.col("_e") % edge_types).cast("int").alias("edge_type"), "dst_type")
    return every.join(counts, TRIPLET, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def symmetric_triplets(edges: DataFrame) -> DataFrame:
    """Named triplets; each stored edge counts in both directions."""
    back = edges.select(F.col("dst_type").alias("src_type"), "edge_type", F.col("src_type").alias("dst_type"))
    return triplets(edges.select(*TRIPLET).union(back)).select(F.concat_ws("-", *TRIPLET).alias("triplet"), "cnt")


def weighted(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """edges with cnt and weight = log10 of the count; unseen triplets weigh 0."""
    out = edges.join(counts, TRIPLET, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return out.withColumn("weight", F.log10(F.greatest("cnt", F.lit(1)).cast("double")))


def edge_costs(edges: DataFrame) -> DataFrame:
    """weighted edges with norm (weight from 0 to 1 in its graph, 0.5 if flat) and cost = 0.5 + 0.5 * (1 - norm)."""
    w = W.partitionBy("graph_id")
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    norm = F.when(hi > lo, (F.col("weight") - lo) / (hi - lo)).otherwise(0.5)
    return edges.withColumn("norm", norm).withColumn("cost", 0.5 + 0.5 * (1 - F.col("norm")))


def triplet_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("cnt").alias("lo"), F.max("cnt").alias("hi"), F.count_if(F.col("cnt") > 0).alias("nonzero"))


def undirected(edges: DataFrame) -> DataFrame:
    """The first stored edge of each pair of nodes."""
    pair = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    first = edges.groupBy("graph_id", *pair).agg(F.min("edge_id").alias("edge_id")).drop("_a", "_b")
    return edges.join(first, ["graph_id", "edge_id"], "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree, counting each pair of nodes once."""
    ordered = F.col("src").isNull() | (F.col("src") <= F.col("dst"))
    pair = edges.select("graph_id", F.when(ordered, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(ordered, F.col("dst")).otherwise(F.col("src")).alias("b")).distinct()
    ends = F.when(F.col("a").eqNullSafe(F.col("b")), F.array("a")).otherwise(F.array("a", "b"))
    return pair.select("graph_id", F.explode(ends).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges (pairs), density, average, largest and least degree, degree sequence."""
    own = nodes.select("graph_id", "node_id", F.lit(True).alias("there"), F.lit(0).cast("long").alias("degree"))
    seen = degrees(edges).dropna(subset=["graph_id", "node_id"]).select("graph_id", "node_id", F.lit(False).alias("there"), "degree")
    d = own.union(seen).groupBy("graph_id", "node_id").agg(F.bool_or("there").alias("there"), F.sum("degree").alias("degree")).filter("there")
    g = d.groupBy("graph_id").agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("e"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.sort_array(F.collect_list("degree"), asc=False).alias("degree_sequence"))
    return g.withColumn("density", F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0))


def odd_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("degree % 2 = 1").select("graph_id", "node_id")


def hamiltonian_screen(packed: DataFrame) -> DataFrame:
    """Per packed graph: verdict and why, of a screen for a Hamiltonian cycle.

    An unconnected graph has none; a least degree of half the nodes, rounded down (Dirac), or summed degrees of the
    nodes for all pairs that no edge joins (Ore), passes; else it fails.
    """
    import bisect

    import pyarrow as pa

    from walkloom.operators.walks import component_roots, packed_rows

    def screen(n, edges):
        near = [set() for _ in range(n)]
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        deg = [len(x) for x in near]
        if any(component_roots(n, edges)):
            return False, "unconnected"
        if min(deg, default=0) >= n // 2:
            return True, "dirac"
        # Of the nodes too small to make up for a's degree, all have to be its neighbours.
        ranked = sorted(deg)
        if all(bisect.bisect_left(ranked, n - d) - (d < n - d) == sum(deg[b] < n - d for b in near[a]) for a, d in enumerate(deg)):
            return True, "ore"
        return False, "neither"

    def run(batches):
        for b in batches:
            rows = [(g, *screen(len(types), [e[:2] for e in edges])) for g, types, edges in packed_rows(b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.string()))], ["graph_id", "verdict", "why"])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, verdict boolean, why string")


def _steps(paths: DataFrame) -> DataFrame:
    n = F.size("path")
    step = F.arrays_zip(F.slice("path", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("src"), F.slice("path", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("dst"))
    return paths.select("graph_id", "path", F.explode_outer(step).alias("s")).select("graph_id", "path", "s.src", "s.dst")


def path_weight(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """For each row of paths (graph_id, path): summed weight of its steps, infinite if an edge is missing, 0 without steps.

    Paths are written once with a number; a step carries that, not its path, so what is shuffled follows the steps.
    """
    rows = saved(paths.select("graph_id", "path").withColumn("_path", F.monotonically_increasing_id()), "paths")
    n = F.greatest(F.size("path") - 1, F.lit(0))
    step = F.arrays_zip(F.slice("path", F.lit(1), n).alias("src"), F.slice("path", F.lit(2), n).alias("dst"))
    steps = rows.select("graph_id", "_path", F.explode(step).alias("s")).select("graph_id", "_path", "s.src", "s.dst")
    w = steps.join(edges.select("graph_id", "src", "dst", "weight"), ["graph_id", "src", "dst"], "left")
    total = w.groupBy("_path").agg(F.sum(F.coalesce("weight", F.lit(float("inf")))).alias("total"))
    return rows.join(total, "_path", "left").select("graph_id", "path", F.coalesce("total", F.lit(0.0)).alias("total"))


def _codes(batch):
    """(src_type, edge_type, dst_type) of all edges of a batch of packed graphs, as an array of three rows, and which of them have both types."""
    import numpy as np

    types, edges = batch.column("types"), batch.column("edges")
    t, e = types.flatten(), edges.flatten()
    sizes = lambda x: np.asarray(x.value_lengths().fill_null(0), dtype=np.int64)
    n = sizes(types)
    begin = np.repeat(np.cumsum(n) - n, sizes(edges))
    known, t = np.asarray(t.is_valid()), np.asarray(t.fill_null(0), dtype=np.int64)
    src, kind, dst = (np.asarray(e.field(c), dtype=np.int64) for c in ("src", "edge_type", "dst"))
    return np.stack([t[begin + src], kind, t[begin + dst]]), known[begin + src] & known[begin + dst]


def packed_triplets(packed: DataFrame) -> DataFrame:
    """As triplets, of packed graphs, but for those with an unknown type. A batch is counted where it is, so only counts are shuffled."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            code, known = _codes(b)
            found, n = np.unique(code[:, known], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in found), pa.array(n.astype(np.int64))], [*TRIPLET, "cnt"])

    each = packed.select("types", "edges").mapInArrow(run, "src_type int, edge_type int, dst_type int, cnt long")
    return each.groupBy(*TRIPLET).agg(F.sum("cnt").alias("cnt"))


def walk_weight(packed: DataFrame, counts: DataFrame, method: str = "feuler") -> DataFrame:
    """graph_id, path, total: a walk of each packed graph, and the summed weight of its steps, as path_weight gives it of weighted edges.

    A graph is a row and has all that its walk's steps weigh, so neither steps nor edges are shuffled. counts are triplets, a row each of a type space, which each task holds.
    """
    import math

    import pyarrow as pa

    from walkloom.operators.walks import packed_rows, walk

    table = {(r["src_type"], r["edge_type"], r["dst_type"]): r["cnt"] for r in counts.collect()}

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                ids, paths, totals = [], [], []
                for g, types, edges in packed_rows(b):
                    edges = [(s, d, t, table.get((types[s], t, types[d]), 0)) for s, d, t, _ in edges]
                    weight = {(s, d): math.log10(max(c, 1)) for s, d, _, c in edges}
                    path = [int(x[5:]) for x in walk(types, edges, method)[1] if x.startswith("node_")]
                    ids.append(g)
                    paths.append(path)
                    totals.append(math.fsum(weight.get(step, math.inf) for step in zip(path, path[1:])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int32())), pa.array(totals, pa.float64())], ["graph_id", "path", "total"])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, path array<int>, total double")


def path_validity(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per path (graph_id, path): whether it is a Hamiltonian path, each node once along edges, and a cycle, where an edge leads back as well.

    For the cycle, the first node at the end once more is left out.
    """
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    e = edges.select("graph_id", "src", "dst").distinct().withColumn("there", F.lit(1))
    closed = (F.size("path") > 1) & (F.get("path", F.lit(0)) == F.element_at("path", -1))
    core = paths.filter(F.size("path") > 0).withColumn("whole", F.col("path")).withColumn("path", F.when(closed, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path")))
    steps = _steps(core.select("graph_id", "path").distinct()).join(e, ["graph_id", "src", "dst"], "left").groupBy("graph_id", "path").agg(F.count_if(F.col("src").isNotNull() & F.col("there").isNull()).alias("missing"))
    ends = core.join(steps, ["graph_id", "path"]).join(size, "graph_id").withColumns({"src": F.element_at("path", -1), "dst": F.get("path", F.lit(0))}).join(e, ["graph_id", "src", "dst"], "left")
    once = (F.col("missing") == 0) & (F.size("path") == F.col("n")) & (F.size(F.array_distinct("path")) == F.col("n"))
    return ends.select("graph_id", F.col("whole").alias("path"), (once & (F.size("whole") == F.size("path"))).alias("is_path"), (once & F.col("there").isNotNull()).alias("is_cycle"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: distinct node and edge types."""
    v = nodes.groupBy("graph_id").agg(F.countDistinct("node_type").alias("node_types"))
    return v.join(edges.groupBy("graph_id").agg(F.countDistinct("edge_type").alias("edge_types")), "graph_id", "left").withColumn("edge_types", F.coalesce("edge_types", F.lit(0)))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("graph_id", column).agg(F.count("*").alias("cnt"))


def components(packed: DataFrame) -> DataFrame:
    """graph_id, node_id, root (least node of the component), rank (from 0, by size downwards, ties to the least root) of packed graphs."""
    import pyarrow as pa

    from walkloom.operators.walks import component_roots

    def run(batches):
        import numpy as np

        for b in batches:
            out: dict = {"graph_id": [], "node_id": [], "root": [], "rank": []}
            for g, types, edges in zip(*(b.column(c) for c in ("graph_id", "types", "edges"))):
                ends = (x.to_numpy() for x in (edges.values.field("src"), edges.values.field("dst"))) if edges.values is not None else ((), ())
                roots = component_roots(len(types), zip(*(x.tolist() if len(x) else [] for x in ends)))
                least, size = np.unique(roots, return_counts=True)
                rank = dict(zip(least[np.lexsort((least, -size))].tolist(), range(len(least))))
                out["graph_id"] += [g.as_py()] * len(roots)
                out["node_id"] += range(len(roots))
                out["root"] += roots
                out["rank"] += [rank[r] for r in roots]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "graph_id" else pa.int32()) for k, v in out.items()], list(out))

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, node_id int, root int, rank int")


def spread_components(nodes: DataFrame, edges: DataFrame, save=saved) -> DataFrame:
    """Components of graphs too large for one row: the least label spreads along edges until none changes. save: writes a step's labels and reads them back."""
    labels = save(nodes.select("graph_id", "node_id", F.col("node_id").alias("root")))
    while True:
        near = edges.join(labels.select("graph_id", F.col("node_id").alias("src"), "root"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("root").alias("_r"))
        new = save(labels.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least("root", F.coalesce("_r", "root")).alias("root"), (F.coalesce("_r", "root") < F.col("root")).alias("moved")))
        discard(labels)
        if not new.filter("moved").limit(1).count():
            return new
        labels = new


def wl_hash(packed: DataFrame, rounds: int = 3) -> DataFrame:
    """graph_id, wl: a Weisfeiler-Lehman digest, of packed graphs. A graph is a row, so no round is shuffled."""
    import pyarrow as pa

    from walkloom.operators.walks import packed_rows

    def run(batches):
        from hashlib import md5

        digest = lambda s: md5(s.encode()).hexdigest()
        for b in batches:
            ids, out = [], []
            for g, types, edges in packed_rows(b):
                labels, near = [digest(str(t)) for t in types], [[] for _ in types]
                for src, dst, kind, _ in edges:
                    near[src].append((dst, f"{kind}:"))
                for _ in range(rounds):
                    labels = [digest(x + "/" + "|".join(sorted([t + labels[u] for u, t in near[v]]))) for v, x in enumerate(labels)]
                ids.append(g)
                out.append(digest("|".join(sorted(labels))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["graph_id", "wl"])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, wl string")


def signature(packed: DataFrame) -> DataFrame:
    """graph_id, signature: a digest of a graph's types and edges in their stored order."""
    types = F.concat_ws(",", F.transform("types", lambda t: t.cast("string")))
    edges = F.concat_ws(",", F.transform("edges", lambda e: F.concat_ws("-", e["src"].cast("string"), e["dst"].cast("string"), e["edge_type"].cast("string"))))
    return packed.select("graph_id", F.md5(F.concat_ws("|", types, edges).cast("binary")).alias("signature"))


def reordered(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows (signature, graph_id) with place: that of the reference row (signature, place) of the same signature, first to first.

    A row without a partner has none.
    """
    nth = lambda order: F.row_number().over(W.partitionBy("signature").orderBy(order))
    return rows.withColumn("_n", nth("graph_id")).join(reference.select("signature", "place", nth("place").alias("_n")), ["signature", "_n"], "left").drop("_n")


def flatten_kinds(nodes: DataFrame) -> DataFrame:
    """Ids over all kinds of a heterogeneous graph: graph_id, kind, local_id, node_id."""
    local = (F.row_number().over(W.partitionBy("graph_id", "kind").orderBy("k")) - 1).cast("int")
    every = (F.row_number().over(W.partitionBy("graph_id").orderBy("kind", "k")) - 1).cast("int")
    return nodes.select("graph_id", "kind", local.alias("local_id"), every.alias("node_id"))


def entropy(p: Column) -> Column:
    return -F.sum(p * F.log(p))
