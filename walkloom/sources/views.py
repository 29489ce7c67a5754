"""Deterministic graph and sequence views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_items(spark, sf_dir, by: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    if by == "order":
        return li.withColumn("graph_id", F.col("l_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("graph_id"))
    return li.join(orders, li["l_orderkey"] == orders["o_orderkey"])


#: Line items that a task gets by graph, about: what it sorts and holds doesn't grow with the table.
TASK_ROWS = 250_000


def _typed(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """graph_id, l_partkey, l_suppkey, kind, src_type, dst_type: a row a line item, all rows of a graph in one of as many tasks as the rows need."""
    kind = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 8).cast("int").alias("src_type"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (8 + F.col("s_nationkey") % 8).cast("int").alias("dst_type"))
    li = _line_items(spark, sf_dir, by).select("graph_id", "l_partkey", "l_suppkey", kind.alias("kind")).join(part, "l_partkey", "left").join(supp, "l_suppkey", "left")
    tasks = -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS)  # from the files' footers
    return li.repartition(max(tasks, 1), "graph_id")


def _dealt(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """graph_id, l_partkey, l_suppkey, src_type, dst_type, edge_type: a row a part-supplier pair of a graph, dealt as _typed."""
    return _typed(spark, sf_dir, by).groupBy("graph_id", "l_partkey", "l_suppkey", "src_type", "dst_type").agg(F.min("kind").alias("edge_type"))


def pairs(spark: SparkSession, sf_dir: str, by: str = "customer") -> DataFrame:
    """graph_id, part, supplier, src, dst, src_type, dst_type, edge_type: a row a part-supplier pair of a graph.

    Types are joined to the line items, and all that is done by graph follows one shuffle by graph_id after that: pairs are summed, and a part's place among
    the graph's parts, then a supplier's among its suppliers, is its node's number.
    """
    li = _dealt(spark, sf_dir, by)
    place = lambda k: F.dense_rank().over(W.partitionBy("graph_id").orderBy(k)) - 1
    li = li.withColumn("src", place("l_partkey").cast("int"))
    n_parts = F.max("src").over(W.partitionBy("graph_id")) + 1
    li = li.withColumn("dst", (place("l_suppkey") + n_parts).cast("int"))
    return li.select("graph_id", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "src", "dst", "src_type", "dst_type", "edge_type")


def nodes(spark: SparkSession, sf_dir: str, by: str = "customer") -> DataFrame:
    """graph_id, kind, k, node_id, node_type: a graph a customer or order; its parts (kind 0), then its suppliers (kind 1), numbered as in pairs by one sort."""
    end = lambda kind, k, type_: F.struct(F.lit(kind).alias("kind"), F.col(k).alias("k"), F.col(type_).alias("node_type"))
    ends = F.explode(F.array(end(0, "l_partkey", "src_type"), end(1, "l_suppkey", "dst_type")))
    each = _typed(spark, sf_dir, by).select("graph_id", ends.alias("v")).select("graph_id", "v.*").distinct()
    number = (F.dense_rank().over(W.partitionBy("graph_id").orderBy("kind", "k")) - 1).cast("int")
    return each.select("graph_id", "kind", "k", number.alias("node_id"), "node_type")


def edges(spark: SparkSession, sf_dir: str, by: str = "customer") -> DataFrame:
    """graph_id, edge_id, src, dst, src_type, dst_type, edge_type: both directions of each part-supplier pair."""
    half = pairs(spark, sf_dir, by)
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"))
    out = half.select("graph_id", F.explode(F.array(F.struct("src", "dst", "src_type", "dst_type"), back)).alias("e"), "edge_type").select("graph_id", "e.*", "edge_type")
    number = (F.row_number().over(W.partitionBy("graph_id").orderBy("src", "dst")) - 1).cast("int")
    return out.withColumn("edge_id", number).select("graph_id", "edge_id", "src", "dst", "src_type", "dst_type", "edge_type")


#: What is added to a supplier's key, so that it isn't a part's.
SUPPLIERS = 1 << 40


def whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (0), edge_id, src, dst, cost: one graph of all line items, both directions of each part-supplier pair. cost: 1 to 3, by the least return flag of the pair."""
    kind = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    half = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(kind).cast("long").alias("cost"))
    a, b = F.col("l_partkey"), F.col("l_suppkey") + SUPPLIERS
    way = lambda x, y, k: F.struct((F.col("l_partkey") * 2_000_000_000 + F.col("l_suppkey") * 2 + k).alias("edge_id"), x.alias("src"), y.alias("dst"))
    return half.select(F.lit(0).cast("long").alias("graph_id"), F.explode(F.array(way(a, b, 0), way(b, a, 1))).alias("e"), "cost").select("graph_id", "e.*", "cost")


def packed_edges(edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """As pack, of graphs whose every node has an edge: types come from the edges' ends, so nodes aren't made apart."""
    if counts is None:
        edges = edges.withColumn("cnt", F.lit(0).cast("long"))
    else:
        edges = edges.join(counts, ["src_type", "edge_type", "dst_type"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    e = F.array_sort(F.collect_list(F.struct("edge_id", "src", "dst", "edge_type", "cnt", "src_type"))).alias("e")
    g = edges.groupBy("graph_id").agg(e)
    ends = F.array_sort(F.array_distinct(F.transform("e", lambda x: F.struct(x["src"].alias("node"), x["src_type"].alias("type")))))
    return g.select("graph_id", F.transform(ends, lambda x: x["type"]).alias("types"), F.transform("e", lambda x: F.struct(x["src"], x["dst"], x["edge_type"], x["cnt"])).alias("edges"))


#: Stands for a null key, which sorts first, as Spark's does.
_NO_KEY = -(2**63)


def _numbered(rows):
    """A packed graph a row, of whole graphs' rows (as of _dealt) in order of graph, part and supplier."""
    import numpy as np
    import pyarrow as pa

    g, part, supp = (np.asarray(rows.column(c).cast(pa.int64()).fill_null(_NO_KEY)) for c in range(3))
    n, changes = len(g), lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(changes(g))
    size = np.diff(np.append(first, n))
    at = np.repeat(np.arange(len(first)), size)
    begin, last = first[at], first + size - 1

    def places(key):
        """Of rows in order of graph and key: which are the first of their key, the key's place in its graph, and how many keys the graphs have."""
        new = changes(key) | changes(at)
        k = np.cumsum(new) - 1
        return new, k - k[begin], k[last] - k[first] + 1

    new_part, src, parts = places(part)
    order = np.lexsort((supp, at))  # by graph, supplier and part: the edges back
    new_supp, place, supps = places(supp[order])
    dst = np.empty(n, np.int64)
    dst[order] = place + parts[at]
    there = np.arange(n) + begin  # edges back follow those there, graph by graph
    back = there + size[at]
    edge = np.empty((3, 2 * n), np.int32)
    kind = np.asarray(rows.column(5))
    edge[:, there], edge[:, back] = (src, dst, kind), (dst[order], src[order], kind[order])
    ends = np.concatenate([[0], np.cumsum(parts + supps)])
    row = np.empty(ends[-1], np.int64)
    row[(ends[at] + src)[new_part]] = np.flatnonzero(new_part)
    row[(ends[at] + dst[order])[new_supp]] = n + order[new_supp]
    types = pa.concat_arrays([rows.column(3), rows.column(4)]).take(pa.array(row))
    edges = pa.StructArray.from_arrays([*map(pa.array, edge), pa.array(np.zeros(2 * n, np.int64))], ["src", "dst", "edge_type", "cnt"])
    offsets = lambda x: pa.array(x.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets(ends), types), pa.ListArray.from_arrays(offsets(2 * np.append(first, n)), edges)]
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), *lists], ["graph_id", "types", "edges"])


def packed(spark: SparkSession, sf_dir: str, by: str = "customer") -> DataFrame:
    """The rows of packed_edges(edges(...)): a task sorts its line items once, and numbers and packs the graphs of a batch at once. A batch's last graph waits for the next."""
    rows = _dealt(spark, sf_dir, by).sortWithinPartitions("graph_id", "l_partkey", "l_suppkey")

    def run(batches):
        import pyarrow as pa

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            whole = next((k for k in range(b.num_rows - 1, -1, -1) if ids[k] != ids[-1]), -1) + 1  # rows of graphs that end here
            if whole or (held and held[-1].column(0)[-1] != ids[0]):
                yield _numbered(pa.concat_batches([*held, b.slice(0, whole)]))
                held = []
            held.append(b.slice(whole))
        if held:
            yield _numbered(pa.concat_batches(held))

    return rows.mapInArrow(run, f"graph_id {rows.schema['graph_id'].dataType.simpleString()}, types array<int>, edges array<struct<src: int, dst: int, edge_type: int, cnt: bigint>>")


def pack(nodes: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row a graph: graph_id, types (by node id), edges (src, dst, type, count) by edge id. counts: triplets, joined in if given."""
    v = nodes.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "node_type"))), lambda x: x["node_type"]).alias("types"))
    if counts is None:
        edges = edges.withColumn("cnt", F.lit(0).cast("long"))
    else:
        edges = edges.join(counts, ["src_type", "edge_type", "dst_type"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    e = edges.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "src", "dst", "edge_type", "cnt"))), lambda x: F.struct(x["src"], x["dst"], x["edge_type"], x["cnt"])).alias("edges"))
    return v.join(e, "graph_id", "left")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, pixels: the 64 values of an embedding as 8 x 8 levels of gray, 0 for the least and 255 for the largest."""
    from walkloom.operators.tokenize import let

    x = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").cast("long").alias("image_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    level = lambda x: F.transform(x["e"], lambda v: F.when(x["hi"] > x["lo"], F.floor((v - x["lo"]) / (x["hi"] - x["lo"]) * 255)).otherwise(0).cast("int"))
    ends = lambda e: F.struct(e.alias("e"), F.array_min(e).alias("lo"), F.array_max(e).alias("hi"))
    return x.select("image_id", "label", let(let(F.col("e"), ends), level).alias("pixels"))


EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (the user), pos, tok: event codes in order of time."""
    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    pos = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), pos.alias("pos"), F.element_at(code, F.col("event_type")).alias("tok"))


def doc_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (the document), pos, tok: code points of its whole text, a row each."""
    from walkloom.operators.tokenize import code_points

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("graph_id"), F.posexplode(code_points("text")).alias("pos", "tok"))


def doc_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (the document), tokens: code points of its whole text, in one row."""
    from walkloom.operators.tokenize import texts_to_points

    return texts_to_points(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("graph_id"), "text"))


def sequences(tokens: DataFrame) -> DataFrame:
    """graph_id, tokens from graph_id, pos, tok."""
    return tokens.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("tokens"))
