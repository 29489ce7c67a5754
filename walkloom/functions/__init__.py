"""SQL surface: functions to call from spark.sql()."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.operators.bpe import Codebook
from walkloom.operators.walks import walk


def register(spark: SparkSession, rules: DataFrame | None = None) -> None:
    """bpe_encode(tokens) if a codebook is given, and the table function graph_walk(types, src, dst, edge_types, method)."""
    if rules is not None:
        book = Codebook([(r["left"], r["right"], r["new_id"]) for r in rules.orderBy("rank").collect()])

        @F.pandas_udf("array<int>")
        def bpe_encode(tokens: pd.Series) -> pd.Series:
            some = tokens.dropna()
            flat = np.concatenate([np.asarray(t, np.int64) for t in some] or [np.zeros(0, np.int64)])
            out, ends, _, _ = book.encode(flat, np.cumsum([len(t) for t in some], dtype=np.int64))
            parts = pd.Series(np.split(out.astype(np.int32), ends[:-1]) if len(some) else [], index=some.index, dtype=object)
            return parts.reindex(tokens.index).where(tokens.notna(), None)

        spark.udf.register("bpe_encode", bpe_encode)

    @F.udtf(returnType="pos int, token int, element string")
    class GraphWalk:
        def eval(self, types, src, dst, edge_types, method):
            edges = [(s, d, t, 0) for s, d, t in zip(src, dst, edge_types)]
            for k, row in enumerate(zip(*walk(types, edges, method))):
                yield (k, *row)

    spark.udtf.register("graph_walk", GraphWalk)
