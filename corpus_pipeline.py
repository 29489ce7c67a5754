"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, for the documents that stay (the mix has some of them more than once, some not at all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walkloom.llm import byte_bpe, jaccard_join, mixing, quality_classifier, quality_rules
from walkloom.llm.common import discard, materialize, scope


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the document with the least doc_id of each group stays."""
    return jaccard_join.keep_one(docs, n=5, p=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    return byte_bpe.digests(byte_bpe.encode(docs))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", near_duplicates), ("mixing", mix), ("byte_bpe", tokens)]

#: The classifier's scores and the tokenizer's ids can't be expressed in SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope() as keep:  # what a stage writes on its way goes when its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
