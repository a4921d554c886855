"""Completed records: store name to file name, kept as a log of puts and removes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblens.schemas import COMPLETED
from joblens.sources import snapshots


def _append(df: DataFrame, path: str, version: int | None) -> None:
    if version is None:
        version = snapshots.next_version(df.sparkSession, path)
    snapshots.append_part(df.withColumn("commit", F.lit(version).cast("bigint")), path, version)


def append_completed(records: DataFrame, path: str, version: int | None = None) -> None:
    """Put (store_name, file_name) records; the last commit of a store name wins."""
    _append(records.select("store_name", "file_name"), path, version)


def remove_completed(store_names: DataFrame, path: str, version: int | None = None) -> None:
    removed = store_names.select("store_name", F.lit(None).cast("string").alias("file_name"))
    _append(removed, path, version)


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    rows = snapshots.read_parts(spark, path)
    if rows is None:
        return spark.createDataFrame([], COMPLETED)
    last = rows.groupBy("store_name").agg(
        F.max_by("file_name", F.struct("commit", F.coalesce("file_name", F.lit("")))).alias(
            "file_name"
        )
    )
    return last.where(F.col("file_name").isNotNull())
