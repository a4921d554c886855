"""The pipeline, stage by stage, on the small tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from joblens.llm import ngram_join
from joblens.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = saved(stage(spark, rows, SF), "test-stage")
        assert rows.columns == docs.columns
        counts[name] = rows.count()
    assert counts["language"] == counts["lines"] == docs.count()
    assert counts["near copies"] < counts["lines"]
    left = rows.dropDuplicates(["doc_id"])
    assert saved(left, "test-left").transform(ngram_join.join_near).where("links > 0").count() == 0


def test_a_null_lang_becomes_the_predicted_one(spark, tmp_path):
    path = str(tmp_path / "docs")
    known = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang")
    known.select(*[hidden if c == "lang" else c for c in known.columns]).write.parquet(path)
    docs = spark.read.parquet(path)
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert got.schema.names == docs.schema.names
    langs = {r.doc_id: r.lang for r in got.collect()}
    texts = known.where("doc_id % 5 = 0 and lang is not null and length(text) >= 200").collect()
    right = [langs[r.doc_id] == r.lang for r in texts if r.doc_id in langs]
    assert len(right) > 10 and sum(right) >= 0.9 * len(right)
    kept = {r.doc_id: r.lang for r in docs.where("lang is not null").collect() if r.doc_id in langs}
    assert kept.items() <= langs.items()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
