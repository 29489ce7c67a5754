"""Sinks and scans of what the engine makes. Every table is Parquet or JSON, written and read by Spark."""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors see: spark.checkpoint.dir; on a single machine without one, a new folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors see")
        top = "file://" + tempfile.mkdtemp(prefix="walkloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/walkloom/{name}-{uuid.uuid4().hex}"


_places: dict[int, tuple] = {}


def opened(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of the scratch folder, as discard() knows it."""
    out = spark.read.schema(schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    return out


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read back: cuts its lineage, and gives later plans its size. discard() deletes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return opened(df.sparkSession, path, df.schema)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _filesystem(spark, path)
    return fs.exists(at)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for t in tables:
        found, path = _places.pop(id(t), (None, None))
        if found is not None and found() is t:
            at, fs = _filesystem(t.sparkSession, path)
            fs.delete(at, True)


class Layers:
    """A table that grows by saved tables, its layers. Where FAN of them are of about one size they are put together, so
    each row is written again as often as its layer's size grows FAN times: what is written follows what is added."""

    FAN = 6

    def __init__(self, combine=lambda df: df):
        """combine: what becomes of the union of some layers."""
        self.combine, self.layers, self.written = combine, [], 0

    def add(self, layer: DataFrame) -> None:
        self._keep(layer)
        while True:
            by: dict[int, list] = {}
            for x in self.layers:
                by.setdefault(int(math.log(x[0], self.FAN)), []).append(x)
            same = next((x for x in by.values() if len(x) >= self.FAN), None)
            if not same:
                return
            whole = saved(self.combine(reduce(DataFrame.unionByName, [x for _, x in same])))
            self.layers = [x for x in self.layers if all(x is not y for y in same)]
            discard(*[x for _, x in same])
            self._keep(whole)

    def _keep(self, layer: DataFrame) -> None:
        rows = layer.count()
        self.written += rows
        if rows:
            self.layers.append((rows, layer))
        else:
            discard(layer)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for _, x in self.layers])

    def discard(self) -> None:
        discard(*[x for _, x in self.layers])
        self.layers = []


def write_graphs(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_packed(path: str, packed: DataFrame, codec: str = "zstd") -> None:
    packed.write.mode("overwrite").option("compression", codec).parquet(path)


def unpack(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of packed graphs."""
    nodes = packed.select("graph_id", F.posexplode("types").alias("node_id", "node_type"))
    edges = packed.select("graph_id", F.posexplode("edges").alias("edge_id", "e")).select("graph_id", "edge_id", "e.*")
    return nodes, edges


def variant_key(k: int | None) -> str:
    return "single" if not k or k < 2 else f"multi_{k}"


def write_sequences(path: str, sequences: DataFrame, method: str, k: int | None = None) -> None:
    """Appends nothing: a (method, variant) partition is replaced."""
    rows = sequences.withColumns({"method": F.lit(method), "variant_key": F.lit(variant_key(k))})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "variant_key").parquet(path)


def read_sequences(spark: SparkSession, path: str, method: str, k: int | None = None) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("method") == method) & (F.col("variant_key") == variant_key(k))).drop("method", "variant_key")


def write_codebook(path: str, rules: DataFrame) -> None:
    if not path.endswith((".json", ".parquet")):
        raise ValueError("a codebook is written as .json or .parquet")
    out = rules.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite")
    (out.json if path.endswith(".json") else out.parquet)(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith((".json", ".parquet")):
        raise ValueError("a codebook is read from .json or .parquet")
    schema = "rank int, left int, right int, new_id int, cnt long"
    return (spark.read.schema(schema).json if path.endswith(".json") else spark.read.schema(schema).parquet)(path).orderBy("rank")


def write_vocab(path: str, vocab: DataFrame) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token int, vocab_id int, freq long").parquet(path)


def write_splits(path: str, splits: DataFrame) -> None:
    """One JSON list of ids a split, as read_splits reads; a list is one row."""
    for split in ("train", "val", "test"):
        ids = splits.filter(F.col("split") == split).agg(F.to_json(F.sort_array(F.collect_list("graph_id"))).alias("value"))
        ids.coalesce(1).write.mode("overwrite").text(f"{path}/{split}.json")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """graph_id, split from one JSON list of ids a split: <path>/<split>.json. A missing one is an error."""
    out = None
    for split in ("train", "val", "test"):
        rows = spark.read.text(f"{path}/{split}.json", wholetext=True).select(F.explode(F.from_json("value", "array<bigint>")).alias("graph_id"), F.lit(split).alias("split"))
        out = rows if out is None else out.union(rows)
    return out


def write_images(path: str, images: DataFrame) -> None:
    """Records of one width, a line each: label and pixels (image_id, label, pixels) as two hexadecimal digits a byte, in order of image_id."""
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    images.orderBy("image_id").select(F.concat(byte(F.col("label")), F.array_join(F.transform("pixels", byte), "")).alias("value")).write.text(path)


def read_images(spark: SparkSession, path: str, pixels: int, hexadecimal: bool = True, split_bytes: int | None = None) -> DataFrame:
    """file, record, label, pixels of files of records of one width: a byte of label, then one a pixel.

    Files are split by byte range, at records, and read in any store that Hadoop reads; record is a record's place in its file, and its number in all
    files if they are one. hexadecimal: lines as write_images writes them, else bytes. A record that is cut off is an error.
    """
    width = 2 * (pixels + 1) + 1 if hexadecimal else pixels + 1
    conf = {"fixedlengthinputformat.record.length": str(width), "mapreduce.input.fileinputformat.input.dir.recursive": "true"}
    if split_bytes:
        conf["mapreduce.input.fileinputformat.split.maxsize"] = str(split_bytes)

    def decoded(pair):
        at, raw = pair
        data = bytes.fromhex(bytes(raw[:-1]).decode()) if hexadecimal else bytes(raw)
        return at // width, data[0], list(data[1:])

    out = None
    for k, file in enumerate(_files(spark, path)):
        rows = spark.sparkContext.newAPIHadoopFile(file, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf).map(decoded)
        part = spark.createDataFrame(rows, "record long, label int, pixels array<int>", verifySchema=False).select(F.lit(k).alias("file"), "record", "label", "pixels")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "file int, record long, label int, pixels array<int>") if out is None else out


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files at path that hold something, in order of their names."""
    at, fs = _filesystem(spark, path)
    found = [(x.getPath().toString(), x.getLen()) for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*" if fs.getFileStatus(at).isDirectory() else path))]
    return sorted(name for name, size in found if size and not name.rpartition("/")[2].startswith(("_", ".")))


def read_aligned_lines(spark: SparkSession, path: str, ids: DataFrame, column: str) -> DataFrame:
    """ids (graph_id) with column: the k-th line, from 0 and without blanks around it, of the text files at path is that of the k-th id; missing lines are empty."""
    from walkloom.operators.large_graph import ranked
    from walkloom.sources.importers import numbered

    places = ranked(ids.withColumn("_all", F.lit(0)), ["_all"], ["graph_id"]).drop("_all")
    lines = numbered(spark, path).select(F.col("line").alias("place"), F.trim("value").alias(column))
    return places.join(lines, "place", "left").drop("place").withColumn(column, F.coalesce(column, F.lit("")))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


#: Keys of an item that describe the graph, and aren't its properties.
STRUCTURE = (
    "dgl_graph graph edge_index edge_attr node_features edge_features num_nodes num_edges adjacency adjacency_matrix node_attr smiles mol molecule rdkit_mol "
    "id index idx dataset_name data_type node_ids edge_ids global_node_ids smiles_1 smiles_2 smiles_3 smiles_4"
).split()


def _members(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, value (variant), kind of the members of an object in a column of variants."""
    rows.createOrReplaceTempView("_items")
    return rows.sparkSession.sql(f"select {key}, x.key as name, x.value as value, schema_of_variant(x.value) as kind from _items, lateral variant_explode({column}) as x")


def properties(items: DataFrame, key: str, column: str = "item") -> DataFrame:
    """key, name, number, text: the properties of items (JSON objects), whatever their keys.

    Of an item's own members, those that describe the graph go; numbers and truth values count as doubles, texts under 50 characters stay, the
    rest goes. Members of an object "properties" are properties as they are, unless the item has a property of that name itself; those that
    are neither number nor text are JSON text.
    """
    parsed = items.select(key, F.expr(f"try_parse_json({column})").alias("item"))
    own = _members(parsed.filter("item is not null"), key, "item")
    is_number = F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    text = F.expr("try_variant_get(value, '$', 'string')")
    number = F.when(F.col("kind") == "BOOLEAN", F.expr("cast(try_variant_get(value, '$', 'boolean') as double)")).otherwise(F.expr("try_variant_get(value, '$', 'double')"))
    typed = lambda df: df.select(key, "name", F.when(is_number, number).alias("number"), F.when(F.col("kind") == "STRING", text).alias("text"), "kind", "value")
    top = typed(own).filter(~F.col("name").isin(*STRUCTURE)).filter(F.col("number").isNotNull() | (F.length("text") < 50)).select(key, "name", "number", "text")
    nested = own.filter((F.col("name") == "properties") & F.col("kind").startswith("OBJECT")).select(key, F.col("value").alias("item"))
    inner = typed(_members(nested, key, "item")).select(key, "name", "number", F.when(F.col("number").isNull(), F.coalesce("text", F.expr("to_json(value)"))).alias("text"))
    return top.unionByName(inner.join(top.select(key, "name"), [key, "name"], "left_anti"))


def resolved_target(available: list[str], name: str | None = None, default: str | None = None) -> str | None:
    """The property of a data set to predict: the one named, which must be there; else the only one; else the default, if it is there. None if there is none at all."""
    if name:
        if name not in available:
            raise ValueError(f"no property {name} in {available}")
        return name
    if len(available) < 2:
        return available[0] if available else None
    if default in available:
        return default
    raise ValueError(f"several properties and no default: {available}")


def target(props: Column, name: str) -> Column:
    """The property to predict, of each row's map; a row without it is an error."""
    return F.when(F.map_contains_key(props, F.lit(name)), F.try_element_at(props, F.lit(name))).otherwise(F.raise_error(F.concat(F.lit(f"no property {name} in "), F.array_join(F.map_keys(props), ", "))).cast("double"))


def own_target(props: Column, name: str | None = None, default: str = "label") -> Column:
    """The property to predict, where rows differ in what they have: of each row's map the one named, else the default, else the only one; a row where that doesn't settle it is an error."""
    has = lambda k: F.map_contains_key(props, F.lit(k))
    found = F.when(has(name), F.try_element_at(props, F.lit(name))) if name else F.when(F.lit(False), F.lit(None).cast("double"))
    found = found.when(has(default), F.try_element_at(props, F.lit(default))).when(F.size(props) == 1, F.get(F.map_values(props), F.lit(0)))
    return found.otherwise(F.raise_error(F.concat(F.lit("no property to predict in "), F.array_join(F.map_keys(props), ", "))).cast("double"))


def names(rows: DataFrame, column: str) -> list[str]:
    """The keys of a column of maps, in order: a row a key is collected."""
    return sorted(r[0] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect())


def read_metrics(spark: SparkSession, path: str, required: tuple[str, ...] = ("dataset", "method"), pattern: str = "*.json", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Runs from a tree of JSON files, and the files skipped, with the reason (keep: value, for what they hold)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    schema = "dataset string, method string, task string, best_val_loss double, test_metrics map<string, double>, val struct<by_aggregation: map<string, map<string, double>>>, test struct<by_aggregation: map<string, map<string, double>>>, time map<string, double>, config map<string, string>"
    rows = raw.withColumn("run", F.from_json("value", schema))
    why = F.concat_ws(",", *[F.when(F.col(f"run.{c}").isNull(), c) for c in required])
    rows = rows.withColumn("reason", why)
    return rows.filter("reason = ''").select("file", "run.*"), rows.filter("reason <> ''").select("file", "reason", *keep)


def four_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles as text with four places, N/A where missing."""
    return df.withColumns({c: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(c).cast("double"))) for c in columns})


def write_report(path: str, df: DataFrame, columns: list[str]) -> None:
    four_places(df, columns).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def digest(df: DataFrame) -> DataFrame:
    """rows, total: a digest of a table that doesn't depend on the order of its rows or columns."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("long").alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows_a, rows_b, only_a, only_b (rows that the other has not, or not as often), same."""
    b = b.select(*a.columns)
    side = lambda df, k: df.groupBy(*a.columns).agg(F.count("*").alias("n")).withColumn("n", F.col("n") * k)
    net = side(a, 1).union(side(b, -1)).groupBy(*a.columns).agg(F.sum("n").alias("d"), F.sum(F.greatest("n", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = net.agg(total(F.col("a")).alias("rows_a"), total(F.col("b")).alias("rows_b"), total(F.greatest("d", F.lit(0))).alias("only_a"), total(F.greatest(-F.col("d"), F.lit(0))).alias("only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merged(base: dict, more: dict) -> dict:
    """Nested settings, overridden key by key."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
