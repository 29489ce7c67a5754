"""Walks of graphs that are spread over rows: breadth-first, topological and Euler walks, and shortest paths.

Edges are rows (graph_id, src, dst, ...); no task and no row holds a graph, and no task all edges of a large node or all rows
of a graph. Work goes in rounds; each writes the rows that it reached, and reads of the others what it needs. Results
equal those of the walks over packed graphs (operators.walks), which are for many small graphs.

rounds, where given, is a list that gets (what, rows) of each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.sources.io import Layers, discard, saved


def ranked(rows: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """rows with place (from 0) and, if a value is named, before (its sum over the rows before) in the order within each group.

    Rows are dealt by range of (group, order), so a group of any size is split; a part's place is the count of its group's rows in the parts before it.
    Rows of one order are placed in any one of their orders. The result is a saved table. Rows are written before they are dealt, as ranges are found by a pass of its own.
    """
    made = saved(rows, "rows")
    spread = saved(made.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranked")
    discard(made)
    amount = [F.sum(value).alias("_v")] if value else []
    totals = spread.groupBy(*by, "_p").agg(F.count("*").alias("_n"), *amount)  # a row a group and part
    earlier = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = {"_n": "_a", "_v": "_b"} if value else {"_n": "_a"}
    starts = totals.select(F.struct(*by, "_p").alias("_g"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(x) for c, x in sums.items()])
    here = W.partitionBy(*by, "_p").orderBy(*order)
    # Only a part's first group can have begun before it: these starts are no more than the parts.
    out = spread.join(F.broadcast(starts.filter("_a > 0")), F.struct(*by, "_p").eqNullSafe(F.col("_g")), "left").drop("_g").fillna(0, list(sums.values()))
    out = out.withColumn("place", F.col("_a") + F.row_number().over(here) - 1)
    if value:
        within = F.coalesce(F.sum(value).over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", F.col("_b") + within)
    out = saved(out.drop("_p", *sums.values()), "ranked")
    discard(spread)
    return out


def least_nodes(edges: DataFrame) -> DataFrame:
    """graph_id, node_id: the least node that has an edge, of each graph."""
    return edges.groupBy("graph_id").agg(F.min(F.least("src", "dst")).alias("node_id"))


def bfs(edges: DataFrame, start: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """graph_id, node_id, root, level, place, parent: the nodes that a breadth-first walk from the start (graph_id, node_id) comes to, in order of place.

    Neighbours go by id, so a level's nodes go by their parent's place, then by id. Several starts in a graph, in parts of it that no edge joins, have a walk each (root).
    """
    start = least_nodes(edges) if start is None else start
    front = saved(start.select("graph_id", "node_id", F.col("node_id").alias("root"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("parent")), "front")
    seen, level = [front], 0
    near = edges.select("graph_id", F.col("src").alias("parent"), F.col("dst").alias("node_id"))
    while front.limit(1).count():
        level += 1
        reach = near.join(front.select("graph_id", F.col("node_id").alias("parent"), "root", F.col("place").alias("p")), ["graph_id", "parent"])
        known = reduce(DataFrame.unionByName, [x.select("graph_id", "node_id") for x in seen])
        new = reach.groupBy("graph_id", "node_id").agg(F.min("p").alias("p"), F.min_by("parent", "p").alias("parent"), F.min_by("root", "p").alias("root")).join(known, ["graph_id", "node_id"], "left_anti")
        before = reduce(DataFrame.unionByName, [x.select("graph_id", "root") for x in seen]).groupBy("graph_id", "root").agg(F.count("*").alias("_seen"))
        placed = ranked(new, ["graph_id", "root"], ["p", "node_id"])
        front = saved(placed.join(before, ["graph_id", "root"]).select("graph_id", "node_id", "root", F.lit(level).alias("level"), (F.col("place") + F.col("_seen")).alias("place"), "parent"), "front")
        discard(placed)
        seen.append(front)
        if rounds is not None:
            rounds.append(("bfs", front.count()))
    out = saved(reduce(DataFrame.unionByName, seen), "bfs")
    discard(*seen)
    return out


def topo(nodes: DataFrame, edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """graph_id, node_id, place: Kahn's order, the least ready node first, of arcs that run from larger to smaller ids.

    What a node makes ready is smaller than it, and it was the least of all that were ready, so what it makes ready comes right
    after it: the order is that of a forest from above, in which a node hangs from its last predecessor. A node's key is
    the path to it, the greatest key of a predecessor and itself; it is known a round after those of all predecessors.
    """
    arcs = saved(edges.filter("src > dst").select("graph_id", "src", "dst").distinct(), "arcs")
    waits = saved(arcs.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("waits")), "waits")
    front = saved(nodes.select("graph_id", "node_id").distinct().join(waits, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", F.array(F.col("node_id").cast("long")).alias("key")), "front")
    done, got = [front], Layers()
    while front.limit(1).count():
        if rounds is not None:
            rounds.append(("topo", front.count()))
        sent = saved(arcs.join(front.select("graph_id", F.col("node_id").alias("src"), "key"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n"), F.max("key").alias("key")), "sent")
        touched = saved(sent.select("graph_id", "node_id"), "touched")
        got.add(sent)  # from here on, sent may be part of another layer
        if not touched.limit(1).count():
            discard(touched)
            break
        # Of the nodes that this round touched, what all rounds sent.
        total = got.all().join(touched, ["graph_id", "node_id"], "left_semi").groupBy("graph_id", "node_id").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
        ready = total.join(waits, ["graph_id", "node_id"]).filter("n = waits")
        front = saved(ready.select("graph_id", "node_id", F.concat("key", F.array(F.col("node_id").cast("long"))).alias("key")), "front")
        discard(touched)
        done.append(front)
    order = ranked(reduce(DataFrame.unionByName, done), ["graph_id"], ["key"])
    out = saved(order.select("graph_id", "node_id", "place"), "topo")
    discard(order)
    got.discard()
    discard(arcs, waits, *done)
    return out


def _pairs(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """graph_id, a, b, copy, there, back: an edge from a to b and one back (a loop has none), a <= b; and the saved tables that it reads.

    Copies of an edge go by edge_id; only pairs that have some are sorted. Fails where an edge has none the other way.
    """
    src, dst, key = F.col("src").cast("long"), F.col("dst").cast("long"), ["graph_id", "a", "b"]
    way = src <= dst
    ends = edges.select("graph_id", F.when(way, src).otherwise(dst).alias("a"), F.when(way, dst).otherwise(src).alias("b"), way.alias("way"), "edge_id")
    both = [F.max(F.when(F.col("way"), F.col("edge_id"))).alias("there"), F.max(F.when(~F.col("way"), F.col("edge_id"))).alias("back")]
    alone = F.col("there").isNull() | (F.col("back").isNull() & (F.col("a") != F.col("b")))
    checked = lambda copy: F.when(alone, F.raise_error(F.lit("an edge has none the other way")).cast("int")).otherwise(copy).alias("copy")
    sums = saved(ends.groupBy(*key).agg(*both, F.greatest(F.count_if("way"), F.count_if(~F.col("way"))).alias("n")).select(*key, checked(F.lit(1)), "there", "back", "n"), "pairs")
    single, many = sums.filter("n = 1").drop("n"), sums.filter("n > 1").select(*key)
    if not many.limit(1).count():
        return single, [sums]
    copy = F.row_number().over(W.partitionBy(*key, "way").orderBy("edge_id"))
    copies = saved(ends.join(many, key, "left_semi").withColumn("copy", copy).groupBy(*key, "copy").agg(*both).select(*key, checked(F.col("copy")), "there", "back"), "pairs")
    return single.unionByName(copies), [sums, copies]


def _neighbours(pairs: DataFrame) -> DataFrame:
    """graph_id, node_id, others: a node's neighbours in lists, of a batch of rows at most, so that a round joins lists and not edges."""
    way = F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
    arcs = pairs.filter("copy = 1 and a <> b").select("graph_id", way.alias("x")).select("graph_id", "x.*")
    arcs = arcs.repartitionByRange("node_id", "other").sortWithinPartitions("node_id", "graph_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if b.num_rows:
                graph, node = (pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in b.columns[:2])
                first = np.flatnonzero(np.concatenate([[True], graph | node]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, b.num_rows).astype(np.int32)), b.column(2))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in b.columns[:2]), lists], ["graph_id", "node_id", "others"])

    return arcs.mapInArrow(run, f"graph_id {arcs.schema['graph_id'].dataType.simpleString()}, node_id long, others array<long>")


def _forest(near: DataFrame, start: DataFrame, rounds: list | None, every: bool = False) -> DataFrame:
    """graph_id, node_id, root, level, parent: a breadth-first forest from the start (graph_id, node_id).

    Each start's id spreads, and the least of them stays: the round that brings a node its last one is its level. With every, all nodes of near start
    as well, and the roots are the least nodes of the parts; their first round needs no join. A parent is the least neighbour of the level before. near: as of _neighbours.
    """
    first, level = start.select("graph_id", F.col("node_id").cast("long").alias("node_id"), F.lit(None).cast("long").alias("_r")), 0
    if every:
        first, level = first.unionByName(near.select("graph_id", "node_id", F.array_min("others").alias("_r"))), 1
    first = first.groupBy("node_id", "graph_id").agg(F.min("_r").alias("_r"))
    labels = saved(first.select("graph_id", "node_id", F.least("node_id", "_r").alias("root"), F.when(F.col("_r") < F.col("node_id"), 1).otherwise(0).alias("level")), "labels")
    while True:
        level += 1
        front = labels.filter(F.col("level") == level - 1).select("graph_id", "node_id", "root")
        sent = near.join(front, ["node_id", "graph_id"]).select("graph_id", F.explode("others").alias("node_id"), "root").groupBy("node_id", "graph_id").agg(F.min("root").alias("_r"))
        moved = F.col("_r").isNotNull() & (F.col("root").isNull() | (F.col("_r") < F.col("root")))
        new = saved(labels.join(sent, ["node_id", "graph_id"], "full").select("graph_id", "node_id", F.least("root", "_r").alias("root"), F.when(moved, level).otherwise(F.col("level")).alias("level")), "labels")
        discard(labels)
        labels = new
        reached = labels.filter(F.col("level") == level)
        if rounds is not None:
            rounds.append(("forest", reached.count()))
        if not reached.limit(1).count():
            break
    # Neighbours are of three levels at most; that of the level before is the least.
    ends = near.join(labels.select("graph_id", "node_id", "level"), ["node_id", "graph_id"]).select("graph_id", F.explode("others").alias("other"), "level", "node_id")
    above = ends.groupBy("graph_id", "other", "level").agg(F.min("node_id").alias("up")).groupBy("graph_id", F.col("other").alias("node_id")).agg(F.min_by("up", "level").alias("up"))
    tree = saved(labels.join(above, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "root", "level", F.when(F.col("level") > 0, F.col("up")).alias("parent")), "forest")
    discard(labels)
    return tree


#: Items of a node that one task sorts at most, about; those of larger nodes are dealt by range.
NODE_ITEMS = 100_000


def _placed(items: DataFrame, large: DataFrame) -> DataFrame:
    """items with before: the summed steps of a node's items before, by the other end and copy. large: the few nodes (graph_id, node_id) whose items several tasks share."""
    node, order = ["node_id", "graph_id"], ["other", "copy"]
    within = F.coalesce(F.sum("steps").over(W.partitionBy(*node).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not large.limit(1).count():
        return saved(items.withColumn("before", within), "placed")
    shared = ranked(items.join(F.broadcast(large), node, "left_semi"), node, order, "steps")
    out = saved(items.join(F.broadcast(large), node, "left_anti").withColumn("before", within).unionByName(shared.drop("place")), "placed")
    discard(shared)
    return out


def euler(edges: DataFrame, roots: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """graph_id, root, pos, edge_id: a closed walk over each directed edge (graph_id, edge_id, src, dst) once, for each part of a graph that edges join.

    Each edge needs one the other way. A breadth-first forest is walked round: into each child and back out after all of its own walk. An
    edge that isn't in the forest is walked out and back from its smaller end, as a circuit that shares this node; so all circuits
    are one. Items of a node go by the other end's id. How long a child's walk is follows from the levels below, where it begins
    from the levels above: a round a level each, of nodes; items are placed once. roots: a node (graph_id, node_id) of each part; by default the least.
    """
    pairs, made = _pairs(edges)
    near = saved(_neighbours(pairs), "near")
    start = pairs.filter("a = b").select("graph_id", F.col("a").alias("node_id")) if roots is None else roots
    tree = _forest(near, start, rounds, roots is None)
    # Items: a pair of edges to and fro (a loop is one edge), at the parent, or at the smaller end.
    into = tree.filter("parent is not null").select("graph_id", F.least("node_id", "parent").alias("a"), F.greatest("node_id", "parent").alias("b"), F.col("node_id").alias("down"), F.lit(1).alias("copy"))
    known = pairs.join(into, ["a", "b", "graph_id", "copy"], "left")
    turned, child = F.col("down").eqNullSafe(F.col("a")), F.col("down").isNotNull()
    ends = {to: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(to) for to, x, y in (("node_id", "a", "b"), ("other", "b", "a"), ("there", "there", "back"), ("back", "back", "there"))}
    items = saved(known.select("graph_id", *ends.values(), "copy", child.alias("child"), F.when(F.col("a") == F.col("b"), 1).otherwise(2).cast("long").alias("steps")), "items")
    nodes = saved(tree.join(items.groupBy("node_id", "graph_id").agg(F.sum("steps").alias("own")), ["graph_id", "node_id"], "left").fillna(0, ["own"]), "nodes")
    # From the deepest level up: the steps of each node's walk.
    depth = nodes.agg(F.max("level")).first()[0] or 0
    none = nodes.limit(0).select("graph_id", "node_id", "parent", "level", F.col("own").alias("size"))
    sizes = []
    for level in range(depth, 0, -1):
        at = nodes.filter(F.col("level") == level)
        if sizes:
            below = sizes[-1].groupBy("graph_id", F.col("parent").alias("node_id")).agg(F.sum("size").alias("below"))
            at = at.join(below, ["graph_id", "node_id"], "left").fillna(0, ["below"]).withColumn("own", F.col("own") + F.col("below"))
        sizes.append(saved(at.select("graph_id", "node_id", "parent", "level", F.col("own").alias("size")), "sizes"))
        if rounds is not None:
            rounds.append(("euler up", sizes[-1].count()))
    size = reduce(DataFrame.unionByName, sizes, none).select("graph_id", F.col("node_id").alias("other"), "level", "size")
    into = saved(items.filter("child").join(size, ["other", "graph_id"]).withColumn("steps", F.col("steps") + F.col("size")).drop("size"), "into")
    placed = _placed(items.filter("not child").withColumn("level", F.lit(None).cast("int")).unionByName(into), nodes.filter(F.col("own") > 2 * NODE_ITEMS).select("graph_id", "node_id"))
    # From the roots down: where each node's walk begins.
    inner = saved(placed.filter("child").select("graph_id", "node_id", "other", "level", "before"), "inner")
    begins = [saved(nodes.filter("level = 0").select("graph_id", "node_id", "root", F.lit(0).cast("long").alias("begin")), "begins")]
    for level in range(1, depth + 1):
        at = inner.filter(F.col("level") == level).join(begins[-1], ["graph_id", "node_id"])
        begins.append(saved(at.select("graph_id", F.col("other").alias("node_id"), "root", (F.col("begin") + F.col("before") + 1).alias("begin")), "begins"))
        if rounds is not None:
            rounds.append(("euler down", begins[-1].count()))
    first = F.col("begin") + F.col("before")
    step = F.array(F.struct(first.alias("pos"), F.col("there").alias("edge_id")), F.when(F.col("node_id") != F.col("other"), F.struct((first + F.col("steps") - 1).alias("pos"), F.col("back").alias("edge_id"))))
    walk = placed.join(reduce(DataFrame.unionByName, begins), ["node_id", "graph_id"]).select("graph_id", "root", F.explode(F.array_compact(step)).alias("x")).select("graph_id", "root", "x.pos", "x.edge_id")
    walk = saved(walk, "euler")
    discard(*made, near, tree, items, nodes, into, placed, inner, *sizes, *begins)
    return walk


def shortest_paths(edges: DataFrame, start: DataFrame, delta: int, rounds: list | None = None) -> DataFrame:
    """graph_id, node_id, dist, predecessors (rising ids): the least summed cost from the start (graph_id, node_id) to each node that it reaches.

    Delta-stepping over tables: edges are (graph_id, src, dst, cost), costs whole and not negative. Nodes are settled by buckets of delta: edges of
    cost up to delta are followed within a bucket until none of its nodes improves, longer ones once, from all that the bucket settled.
    """
    if delta < 1:
        raise ValueError("a bucket is at least 1 wide")
    near = saved(edges.groupBy("graph_id", F.col("src").alias("from"), F.col("dst").alias("node_id")).agg(F.min("cost").cast("long").alias("cost")), "near")
    least = lambda df: df.groupBy("graph_id", "node_id").agg(F.min("dist").alias("dist"))
    dist = Layers(least)
    dist.add(saved(start.select("graph_id", "node_id", F.lit(0).cast("long").alias("dist")).distinct(), "dist"))

    def relax(front: DataFrame, light: bool, what: str) -> DataFrame:
        """The nodes that edges from front bring nearer; they are added."""
        arcs = near.filter(F.col("cost") <= delta if light else F.col("cost") > delta)
        reach = least(arcs.join(front.select("graph_id", F.col("node_id").alias("from"), F.col("dist").alias("d")), ["graph_id", "from"]).select("graph_id", "node_id", (F.col("d") + F.col("cost")).alias("dist")))
        now = least(dist.all()).withColumnRenamed("dist", "now")
        better = saved(reach.join(now, ["graph_id", "node_id"], "left").filter("now is null or dist < now").select("graph_id", "node_id", "dist"), "better")
        if rounds is not None:
            rounds.append((what, better.count()))
        return better

    bucket, empty = 0, not dist.layers
    while not empty:
        inside = (F.col("dist") >= bucket * delta) & (F.col("dist") < (bucket + 1) * delta)
        front, old = saved(least(dist.all()).filter(inside), "front"), []
        while front.limit(1).count():
            better = relax(front, True, "light")
            old.append(front)
            front = saved(better.filter(inside), "front")
            dist.add(better)
        settled = saved(least(dist.all()).filter(inside), "settled")
        dist.add(relax(settled, False, "heavy"))
        discard(front, settled, *old)
        nearest = least(dist.all()).filter(F.col("dist") >= (bucket + 1) * delta).agg(F.min("dist")).first()[0]
        empty = nearest is None
        bucket = bucket if empty else nearest // delta
    final = saved(least(dist.all()), "final") if dist.layers else start.select("graph_id", "node_id", F.lit(0).cast("long").alias("dist"))
    tight = near.join(final.select("graph_id", F.col("node_id").alias("from"), F.col("dist").alias("d")), ["graph_id", "from"]).join(final, ["graph_id", "node_id"]).filter((F.col("d") + F.col("cost") == F.col("dist")) & (F.col("from") != F.col("node_id")))
    lists = tight.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list("from")).alias("predecessors"))
    out = saved(final.join(lists, ["graph_id", "node_id"], "left").withColumn("predecessors", F.coalesce("predecessors", F.array().cast("array<long>"))), "paths")
    dist.discard()
    discard(near, final)
    return out
