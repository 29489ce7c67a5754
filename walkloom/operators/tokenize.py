"""Tokens of nodes, edges, images and strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNEL_BIAS = 1_000_000
#: Symbols by atomic number, and bond codes.
SYMBOLS = {1: "H", 6: "C", 7: "N", 8: "O", 9: "F", 15: "P", 16: "S", 17: "Cl", 35: "Br", 53: "I"}
BONDS = {0: 1, 1: 2, 2: 3, 3: 4}
GLYPHS = {1: "-", 2: "=", 3: "#", 4: ":"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once a row: Spark puts what makes a column in its place, so within a lambda it would be made again for each member."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def node_token(t) -> Column:
    return (F.col(t) if isinstance(t, str) else t) * 2 + 1


def edge_token(t) -> Column:
    return (F.col(t) if isinstance(t, str) else t) * 2


def token_type(token) -> Column:
    """The type a node (odd) or edge (even) token stands for."""
    return F.shiftright(F.col(token) if isinstance(token, str) else token, 1)


def two_channels(a: str, b: str, bias: int = CHANNEL_BIAS) -> Column:
    return F.array(F.col(a) * 2 + 1, F.col(b) * 2 + 1 + F.lit(bias))


def repaired(df: DataFrame, token: str, by: str = "graph_id", odd: bool = True) -> DataFrame:
    """Tokens of a graph that has any of the wrong parity are read as types and encoded."""
    wrong = F.max(F.when(F.col(token) % 2 == (0 if odd else 1), 1).otherwise(0)).over(W.partitionBy(by)) == 1
    return df.withColumn(token, F.when(wrong, node_token(token) if odd else edge_token(token)).otherwise(F.col(token)))


def repaired_features(edges: DataFrame) -> DataFrame:
    """graph_id, kind (node or edge), id, token: the tokens of all nodes and edges of graphs whose every node has an edge from it, read from their types and repaired.

    Node tokens are odd: a graph that has any even one has 2t + 1. Edge tokens are even: a graph that has any odd one has 2t. Edges are dealt and sorted once for both.
    """
    before = F.lag("src").over(W.partitionBy("graph_id").orderBy("src", "dst", "edge_id"))
    x = edges.withColumns({"_first": F.coalesce(before != F.col("src"), F.lit(True)), "_node": F.col("src_type"), "_edge": F.col("edge_type")})
    x = repaired(repaired(x, "_node"), "_edge", odd=False)
    row = lambda kind, k, token: F.struct(F.lit(kind).alias("kind"), F.col(k).alias("id"), F.col(token).alias("token"))
    both, edge = (F.array(*r, row("edge", "edge_id", "_edge")) for r in ([row("node", "src", "_node")], []))
    return x.select("graph_id", F.explode(F.when(F.col("_first"), both).otherwise(edge)).alias("x")).select("graph_id", "x.*")


def bitmask(bits: Column) -> Column:
    return F.aggregate(F.transform(bits, lambda x, i: F.when(x != 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, x: a + x)


def argmax_class(a: Column) -> Column:
    """The place, from 1, of the first largest member."""
    return F.array_position(a, F.array_max(a)).cast("int")


def dense_ids(df: DataFrame, columns: list[str], to: str = "type_id") -> DataFrame:
    """df with the rank, from 0, of its distinct tuple. Tuples are few; rows join to them."""
    ranks = df.select(*columns).distinct().withColumn(to, (F.dense_rank().over(W.orderBy(*columns)) - 1).cast("int"))
    return df.join(ranks, columns, "left")


def product_type(a: str, b: str) -> Column:
    return F.col(a).cast("bigint") * F.col(b).cast("bigint")


def bond_code(c: str) -> Column:
    return F.coalesce(F.try_element_at(_map(BONDS), F.col(c).cast("int")), F.lit(0))


def code_points(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.when(F.length(s) > 0, F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def texts_to_points(rows: DataFrame) -> DataFrame:
    """graph_id, tokens of rows (graph_id, text), by Arrow: a text's UTF-32 units are its code points. Null text is empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                points = [np.frombuffer((t.as_py() or "").encode("utf-32-le"), np.int32) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, points)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*points, np.zeros(0, np.int32)])))], ["graph_id", "tokens"])

    return rows.select(F.col("graph_id").cast("long"), "text").mapInArrow(run, "graph_id long, tokens array<int>")


def readable(tokens: str) -> Column:
    """Element symbols for odd tokens, bond glyphs for even ones."""
    return F.concat_ws("", F.transform(tokens, lambda t: F.coalesce(F.when(t % 2 == 1, F.try_element_at(_map(SYMBOLS), F.shiftright(t, 1))).otherwise(F.try_element_at(_map(GLYPHS), F.shiftright(t, 1))), F.lit("?"))))


def token_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, value, token of the types that nodes (node_type) and edges (edge_type) of a data set have."""
    v = nodes.select(F.lit("node").alias("kind"), F.col("node_type").cast("int").alias("value"), node_token("node_type").cast("int").alias("token")).distinct()
    return v.union(edges.select(F.lit("edge"), F.col("edge_type").cast("int"), edge_token("edge_type").cast("int")).distinct())


def discrete_columns(df: DataFrame, vector: str, first: int = 64) -> DataFrame:
    """For each place of a vector column: least, largest, whether all are whole, and whether all are 0 or 1."""
    x = df.select(F.posexplode(F.slice(vector, 1, first)).alias("col", "v"))
    return x.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"), F.bool_and(F.col("v").isin(0, 1)).alias("binary"))


def image_order(h: int, w: int, how: str) -> Column:
    """Places of an h x w image in scanning order: row_major, serpentine, diag_zigzag, or row, col, snake, diag of flattened images."""
    keys = {
        "row_major": lambda r, c: (r, c),
        "serpentine": lambda r, c: (r, c if r % 2 == 0 else -c),
        "diag_zigzag": lambda r, c: (r + c, -r if (r + c) % 2 == 0 else r),
        "col": lambda r, c: (c, r),
        "diag": lambda r, c: (r + c, r if (r + c) % 2 == 0 else -r),
    }
    key = keys[{"row": "row_major", "snake": "serpentine"}.get(how, how)]
    return F.lit(sorted(range(h * w), key=lambda i: key(*divmod(i, w))))  # a constant: Spark would sort it again for each row
