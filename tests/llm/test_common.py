"""Row numbers are the same however the files are split."""

from pyspark.sql import functions as F

from joblens.llm import line_dedup
from joblens.llm.common import numbered


def numbers(rows) -> dict:
    return {row.key: row.uid for row in rows.select("uid", F.col("row.key").alias("key")).collect()}


def test_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.repartition(5).write.option("parquet.block.size", 1 << 16).parquet(path)
    docs = spark.read.parquet(path)
    whole = numbers(numbered(docs))
    assert len(set(whole.values())) == 20_000
    first = numbered(docs)
    conf, name = spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    conf.set(name, 1 << 17)
    try:
        assert numbers(numbered(docs)) == whole
        assert numbers(first.where("uid >= 0")) == whole
        assert numbers(numbered(docs.where("key % 2 = 0").select("key"))).items() <= whole.items()
    finally:
        conf.set(name, before)


def test_rows_that_are_not_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10).select(F.col("id").alias("key")).write.parquet(path)
    docs = spark.read.parquet(path)
    for rows, n in ((docs.union(docs), 20), (spark.range(7).select(F.col("id").alias("key")), 7), (docs.limit(0), 0)):
        assert numbered(rows).select("uid").distinct().count() == n


def test_lines_keep_their_rows_when_splits_change(spark, tmp_path, monkeypatch):
    """The files are dealt out another way in the last phase."""
    path = str(tmp_path / "docs")
    texts = [(i, f"line {i} of a b c d\nother {i} x y z {i}\nsame for all of them") for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    want = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).select("row.doc_id", "text").collect())
    conf, name = spark.conf, "spark.sql.files.openCostInBytes"
    before, kept = conf.get(name), line_dedup.kept_lines

    def other_splits(*args):
        stays = kept(*args).localCheckpoint()
        conf.set(name, 0)  # all files in one task
        return stays

    monkeypatch.setattr(line_dedup, "kept_lines", other_splits)
    try:
        got = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).select("row.doc_id", "text").collect())
    finally:
        conf.set(name, before)
    assert got == want
