"""Run a stream over what is there now and hand back its output table."""

from pyspark.sql import Column, DataFrame, SparkSession

from joblens.session import scratch_dir
from joblens.sources.snapshots import is_folder


def read_table_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream a parquet table, which may be a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def in_batches(rows: DataFrame, turn: Column, count: int, name: str, **options) -> DataFrame:
    """A stream that brings the rows of turn 0, 1, ... in one batch each."""
    spark = rows.sparkSession
    path = scratch_dir(spark, name)
    for number in range(count):
        rows.where(turn == number).coalesce(1).write.mode("append").parquet(path)
    return read_table_stream(spark, path, maxFilesPerTrigger="1", **options)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append everything available to a fresh table."""
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
