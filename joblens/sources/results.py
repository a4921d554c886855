"""Result files and their contents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_results(spark: SparkSession, path: str, in_folders: bool = False) -> DataFrame:
    """(store_name, modification_time, end_ms, length) of every file. Contents are not read.

    A file is named by its store name, or with `in_folders` lies in a folder `store_name=...`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(in_folders)).load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    if in_folders:
        name = F.regexp_replace(F.element_at(parts, -2), "^store_name=", "")
    return files.select(name.alias("_name"), "modificationTime", "length").select(
        F.try_url_decode(F.replace("_name", F.lit("+"), F.lit("%2B"))).alias("store_name"),
        F.col("modificationTime").alias("modification_time"),
        F.unix_millis("modificationTime").alias("end_ms"),
        "length",
    )


def duplicate_files(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """(content_hash, n, first_id) of contents that occur more than once."""
    hashed = files.select(file_id, content_hash(F.col(content)).alias("content_hash"))
    return (
        hashed.groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min(file_id).alias("first_id"))
        .where("n > 1")
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
