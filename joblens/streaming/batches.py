"""Micro-batches as plain batch jobs, with state and output in tables.

A batch's rows are worked on by the batch operators, hot keys included. What a key carries to later
batches is one row, which comes back as the key's first row in the next batch that has the key.
State and output of batch n are written to folders of their own (`batch=n`), which a repeated batch
replaces, and a batch only reads state of earlier ones, so a batch that runs again changes nothing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joblens.session import scratch_dir
from joblens.sources.snapshots import exists

#: Every so manieth batch writes the state of all keys, the others that of their own keys only.
FOLD_EVERY = 16

#: Order of the rows of a key: what it carries (0), then its new rows (1).
TURN = "_turn"


def put(rows: DataFrame, base: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")


def stored(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """All batches of a table, with their number in `batch`; no rows before the first one."""
    if not exists(spark, f"{base}/{name}/batch=*"):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{base}/{name}")


class KeyedState:
    """A row per key, as of the start of a batch; a row with `gone` ends its key."""

    def __init__(
        self, spark: SparkSession, base: str, key: str, columns: str, fold_every: int = FOLD_EVERY
    ):
        self.spark, self.base, self.key, self.fold_every = spark, base, key, fold_every
        self.schema = f"{columns}, gone boolean"

    def before(self, batch: int) -> DataFrame:
        """The latest row of each key, from the batches since the last full one."""
        full = max(batch - 1, 0) // self.fold_every * self.fold_every
        rows = stored(self.spark, self.base, "state", self.schema)
        rows = rows.where((F.col("batch") >= full) & (F.col("batch") < batch))
        names = [name for name in rows.columns if name not in (self.key, "batch")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("_last"))
        return last.select(self.key, "_last.*").where("not gone").drop("gone")

    def carried(self, rows: DataFrame, batch: int) -> DataFrame:
        """State of the keys that `rows` have."""
        return self.before(batch).join(rows.select(self.key), self.key, "left_semi")

    def write(self, changed: DataFrame, batch: int) -> None:
        """`changed` has the new state of the batch's keys, with `gone` where they end."""
        if batch and batch % self.fold_every == 0:
            kept = self.before(batch).join(changed, self.key, "left_anti")
            changed = changed.where("not gone").unionByName(kept.withColumn("gone", F.lit(False)))
        put(changed, self.base, "state", batch)


def run_batches(
    stream: DataFrame, base: str, step: Callable[[DataFrame, int], None], **trigger
) -> StreamingQuery:
    """Start a query that gives every micro-batch and its number to `step`."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain_batches(
    stream: DataFrame, name: str, start: Callable[..., StreamingQuery], schema: str, **options
) -> DataFrame:
    """What `start(stream, base, **options)` has put out once everything available is read."""
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    start(stream, base, **options).awaitTermination()
    return stored(spark, base, "out", schema).drop("batch")
