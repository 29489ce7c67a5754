"""Graph data sets as published in text files, read into tables of graphs, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.sources.io import saved


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of the text file or folder at path, files in order of their names.

    A file is split among tasks; lines are counted a split, and numbered from the sums of the splits before. No table is sorted.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = saved(spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("m"), "value"), "lines")
    blocks = raw.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("file", "block")) - F.col("n")  # a row a split
    blocks = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(blocks), ["file", "block"]).select((F.col("m") + F.col("shift")).alias("line"), "value")


def read_tu(spark: SparkSession, folder: str, name: str, node_labels: bool = True, edge_labels: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs (graph_id, label), nodes (graph_id, node_id, node_type), edges (graph_id, edge_id, src, dst, edge_type) of a TU data set.

    Its files: <name>_A.txt (an edge "u, v" a line), <name>_graph_indicator.txt (a node's graph a line), <name>_graph_labels.txt,
    and, if there are any, <name>_node_labels.txt and <name>_edge_labels.txt. They count graphs and nodes from 1; here
    both count from 0, and nodes within their graph. Types without a file are 0. Edges are numbered in the order of their lines.
    """
    lines = lambda part: numbered(spark, f"{folder}/{name}_{part}.txt")
    whole = F.trim("value").cast("int")
    graphs = lines("graph_labels").select(F.col("line").alias("graph_id"), whole.alias("label"))

    member = saved(lines("graph_indicator").select("line", (whole.cast("long") - 1).alias("graph_id")), "members")
    first = member.groupBy("graph_id").agg(F.min("line").alias("first"))
    nodes = member.join(first, "graph_id").select("line", "graph_id", (F.col("line") - F.col("first")).cast("int").alias("node_id"))
    types = lines("node_labels").select("line", whole.alias("node_type")) if node_labels else None
    nodes = saved(nodes.join(types, "line", "left") if node_labels else nodes.withColumn("node_type", F.lit(0)), "nodes")

    end = lambda k: (F.trim(F.split_part("value", F.lit(","), F.lit(k))).cast("long") - 1)
    edges = lines("A").select(F.col("line").alias("at"), end(1).alias("u"), end(2).alias("v"))
    if edge_labels:
        edges = edges.join(lines("edge_labels").select(F.col("line").alias("at"), whole.alias("edge_type")), "at", "left")
    else:
        edges = edges.withColumn("edge_type", F.lit(0))
    edges = edges.join(nodes.select(F.col("line").alias("u"), "graph_id", F.col("node_id").alias("src")), "u")
    # Edges don't leave their graph, so its first node's line gives the other end.
    edges = edges.join(first, "graph_id").withColumn("dst", (F.col("v") - F.col("first")).cast("int"))
    number = (F.row_number().over(W.partitionBy("graph_id").orderBy("at")) - 1).cast("int")
    return graphs, nodes.drop("line"), edges.select("graph_id", number.alias("edge_id"), "src", "dst", "edge_type")


#: Lines that are dealt at once to one graph.
RUN = 4096


def _owners(counts: DataFrame) -> DataFrame:
    """line, graph_id, at: each line's graph and its place there, of the numbers of lines of graphs (graph_id, n) one after another.

    These are as many rows as lines, though Spark takes them for as few bytes as the counts have, and would broadcast them: joins to them name their kind.
    """
    from walkloom.operators.large_graph import ranked

    begins = ranked(counts.withColumn("_all", F.lit(0)), ["_all"], ["graph_id"], "n").filter("n > 0")
    runs = begins.select("graph_id", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("run"))
    at = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)).alias("at")
    return runs.select("graph_id", "before", at).select((F.col("before") + F.col("at")).alias("line"), "graph_id", F.col("at").cast("int").alias("at"))


def read_counted(spark: SparkSession, folder: str, both_ways: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs (graph_id, label), nodes (graph_id, node_id, node_type), edges (graph_id, edge_id, src, dst, edge_type) of a data set in counted files.

    Its files have a line a graph: num-node-list.csv, num-edge-list.csv and graph-label.csv; a line a node, graph after graph: node-feat.csv,
    whose first column counts from 0 where types do from 1; a line an edge: edge.csv ("src,dst" within the graph) and edge-feat.csv, whose first
    column 0 to 3 is type 1 to 4 and any other 0. No line has an id: counts and the lines' numbers give the graphs. both_ways: an edge back after each.
    """
    lines = lambda name: numbered(spark, f"{folder}/{name}.csv")
    field = lambda k, t: F.trim(F.split_part("value", F.lit(","), F.lit(k))).cast(t)
    count = lambda name: lines(name).select(F.col("line").alias("graph_id"), field(1, "long").alias("n"))
    graphs = lines("graph-label").select(F.col("line").alias("graph_id"), field(1, "double").alias("label"))
    nodes = _owners(count("num-node-list")).hint("merge").join(lines("node-feat").select("line", (field(1, "int") + 1).alias("node_type")), "line").select("graph_id", F.col("at").alias("node_id"), "node_type")
    kind = field(1, "int")
    ends = lines("edge").select("line", field(1, "int").alias("src"), field(2, "int").alias("dst"))
    types = lines("edge-feat").select("line", F.when(kind.between(0, 3), kind + 1).otherwise(0).alias("edge_type"))
    edges = _owners(count("num-edge-list")).hint("merge").join(ends, "line").join(types.hint("merge"), "line", "left").withColumn("edge_type", F.coalesce("edge_type", F.lit(0)))
    if both_ways:
        way = lambda k, a, b: F.struct((2 * F.col("at") + k).alias("edge_id"), F.col(a).alias("src"), F.col(b).alias("dst"))
        edges = edges.select("graph_id", F.explode(F.array(way(0, "src", "dst"), way(1, "dst", "src"))).alias("e"), "edge_type").select("graph_id", "e.*", "edge_type")
    else:
        edges = edges.select("graph_id", F.col("at").alias("edge_id"), "src", "dst", "edge_type")
    return graphs, nodes, edges


#: Layouts by name: functions of (spark, folder, ...) that give graphs, nodes and edges.
LAYOUTS = {"tu": read_tu, "counted": read_counted}


def register(layout: str, loader) -> None:
    """Adds a layout; a name that is taken is an error."""
    if layout in LAYOUTS:
        raise ValueError(f"there is a layout {layout} already")
    LAYOUTS[layout] = loader


def load(spark: SparkSession, layout: str, folder: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs, nodes and edges of a data set in a layout of that name, with the columns that every layout gives."""
    if layout not in LAYOUTS:
        raise ValueError(f"no layout {layout}: there are {', '.join(sorted(LAYOUTS))}")
    graphs, nodes, edges = LAYOUTS[layout](spark, folder, **options)
    return graphs.select("graph_id", "label"), nodes.select("graph_id", "node_id", "node_type"), edges.select("graph_id", "edge_id", "src", "dst", "edge_type")
