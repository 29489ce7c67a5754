"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.llm import ann_forest, byte_bpe, chat_format, conversation_repair, filter_audit, html_extract, jaccard_join, mixing, quality_classifier, quality_rules, sharding, toxicity, warc
from walkloom.llm.common import materialize, table, words
from walkloom.llm.oracles import SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    got = chat_format.read_back(chat_format.expand(chat_format.format_conversations(rows)))
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.apply_policy(led).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the stored ledger: rules are evaluated once for all."""
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return quality_rules.ablations(materialize(led, "ledger"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard_by_bytes(rows, 24, ("doc_id",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_forest.search(rows, rows.filter(F.col("vec_id") % 20 == 0), top=20)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, p=90).select("doc_id", "n_shingles", "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write(warc.plan_records(pages, min_bytes=0))
    # What was just written has no gaps; one is an error, not a missing row.
    whole = F.when(F.col("kind") == "record", F.col("page_id")).otherwise(F.raise_error(F.format_string("gap in %s at %s", "name", "at")).cast("long"))
    return warc.read(archives).select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    out = mixing.mixed(materialize(sized, "sized"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_chat_format": op2_chat_format, "op3_quality_rules": op3_quality_rules, "op4_sharding": op4_sharding,
    "op5_byte_bpe": op5_byte_bpe, "op6_quality_classifier": op6_quality_classifier, "op7_ann_forest": op7_ann_forest, "op8_jaccard_join": op8_jaccard_join,
    "op9_warc": op9_warc, "op10_mixing": op10_mixing, "op11_filter_audit": op11_filter_audit, "op12_html_extract": op12_html_extract, "op13_conversation_repair": op13_conversation_repair,
    "quality_rule_ablations": quality_rule_ablations,
}
ORACLE_SQL: dict[str, str] = dict(SQL)
