"""Registered queries over the test tables, and their SQL for DuckDB. Keys are the operators' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.operators.graph import triplets
from walkloom.plans import graph_queries, image_queries, table_queries
from walkloom.sources import views

QUERIES = graph_queries.Q | image_queries.Q | table_queries.Q
ORACLE_SQL = graph_queries.S | image_queries.S | table_queries.S


def triplet_frequency(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """The commonest typed triplets of the customer graphs."""
    return triplets(views.edges(spark, sf_dir)).orderBy(F.col("cnt").desc(), "src_type", "edge_type", "dst_type").limit(top)
