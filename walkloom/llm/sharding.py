"""Sharding by global byte-size prefix sums: rows in one global order, sizes summed by partition, and the
prefix cut at equal targets, which gives contiguous shards whose sizes differ by less than two rows' bytes.

Defined results: the order is by the given columns, null first; rows equal in them are parted by a
hash, so that a key with any share of the rows fills many partitions; an empty table gives no rows;
other columns pass through, those named as what is made here are replaced; a null size counts as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_by_bytes(rows: DataFrame, shards: int = 24, order: tuple[str, ...] = ("doc_id",), size: str = "size") -> DataFrame:
    """rows with shard (int) and slot (long, from 0 in each shard). size: a column of longs above 0.

    Driver: two numbers a partition and one a shard. A middle of a row decides its shard.
    """
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [*[f"_o{k}" for k in range(len(order))], "_salt"]
    # In one column, so that no column of rows clashes with what is made.
    spread = rows.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), *[F.col(c).alias(k) for c, k in zip(order, keys)], F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    # checkpoint() keeps partitions and their order; the numbers below hold for it alone.
    fixed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_row", "_size", F.spark_partition_id().alias("_part"))
    fixed = _checkpoint(fixed)
    totals = fixed.groupBy("_part").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).orderBy("_part").collect()
    at, bytes_before, rows_before = {}, 0, 0
    for t in totals:
        at[t["_part"]] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + t["b"], rows_before + t["n"]
    total = max(bytes_before, 1)

    def place(batches, part, seen):
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
                seen = list(at[part])
            sizes = np.asarray(batch.column(batch.schema.get_field_index("_size")), dtype=np.int64)
            ends = seen[0] + np.cumsum(sizes)
            shard = np.minimum((2 * ends - sizes) * shards // (2 * total), shards - 1).astype(np.int32)
            index = seen[1] + np.arange(len(sizes), dtype=np.int64)
            seen[0], seen[1] = int(ends[-1]), seen[1] + len(sizes)
            yield batch, shard, index

    def first(batches):
        for _, shard, index in place(batches, None, None):
            found, where = np.unique(shard, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(index[where], pa.int64())], ["shard", "first"])

    starts = {r["shard"]: r["first"] for r in fixed.select("_part", "_size").mapInArrow(first, "shard int, first long").groupBy("shard").agg(F.min("first").alias("first")).collect()}

    def number(batches):
        base = np.array([starts.get(k, 0) for k in range(shards)], dtype=np.int64)
        for batch, shard, index in place(batches, None, None):
            names, cols = batch.schema.names, list(batch.columns)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shard, pa.int32()), pa.array(index - base[shard], pa.int64())], [*names, "shard", "slot"])

    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    out = StructType([*fixed.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    return fixed.mapInArrow(number, out).select("_row.*", "shard", "slot")


def _checkpoint(df: DataFrame) -> DataFrame:
    from walkloom.llm.common import shared_dir

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
