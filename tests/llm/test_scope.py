"""Written tables: their scope, and what a whole run leaves."""

import glob

import corpus_pipeline
from walkloom.llm import common


def left(spark):
    return set(glob.glob(common.shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/walkloom/*"))


def test_scope(spark):
    before = left(spark)
    with common.scope() as keep:
        a = common.materialize(spark.range(3), "a")
        b = keep(common.materialize(a.selectExpr("id * 2 as id"), "b"))
        c = common.materialize(spark.range(1), "c")
        common.discard(c)
    assert [r[0] for r in b.orderBy("id").collect()] == [0, 2, 4] and len(left(spark) - before) == 1
    common.discard(b, b)
    assert left(spark) == before


def test_nothing_stays_of_stages(spark, monkeypatch, tmp_path):
    """A run leaves the table that its last stage reads, and no other of its stages."""
    stages = [("one", lambda s, d, _: common.materialize(d, "inner").filter("doc_id > 1")), ("two", lambda s, d, _: common.materialize(d, "inner").filter("doc_id > 2")), ("three", lambda s, d, _: d)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    spark.range(6).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    before = left(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert len(left(spark) - before) == 1
