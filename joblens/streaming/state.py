"""Streaming status transitions, submission reuse and upserts."""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from joblens.operators.state import latest_by, owned
from joblens.plans.ordered import Chunks, running_sums, with_previous
from joblens.schemas import CREATED, DELETE, FAILED, SUBMIT
from joblens.sources import snapshots
from joblens.streaming.batches import FOLD_EVERY, TURN, KeyedState, put, run_batches

ORDER = [TURN, "ts", "version"]


def transitions_schema(stream: DataFrame) -> str:
    types = dict(stream.dtypes)
    return (
        f"job_id {types['job_id']}, seq bigint, status string, "
        f"ts {types['ts']}, version {types['version']}"
    )


def stream_transitions(
    stream: DataFrame, base: str, fold_every: int = FOLD_EVERY, trigger: dict | None = None, **sizes
) -> StreamingQuery:
    """Start a query that puts (job_id, seq, status, ts, version), numbered status changes, out.

    Takes (job_id, status, ts, version). A job carries its last status and how many it has sent.
    """
    spark, types = stream.sparkSession, dict(stream.dtypes)
    columns = f"job_id {types['job_id']}, status string, sent bigint"
    state = KeyedState(spark, base, "job_id", columns, fold_every)

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(F.lit(1).alias(TURN), "job_id", "status", "ts", "version")
        carried = state.carried(new, number).withColumn(TURN, F.lit(0))
        rows = new.unionByName(carried, allowMissingColumns=True)
        chunks = Chunks(rows, ["job_id"], ORDER, **sizes)
        rows = with_previous(chunks, chunks.rows, "status", "_previous")
        changed = F.col("status") != F.coalesce("_previous", F.lit(CREATED))
        rows = rows.withColumn("_sent", F.coalesce("sent", changed.cast("bigint")))
        rows = chunks.done(running_sums(chunks, rows, {"seq": "_sent"})).persist()
        out = rows.where((F.col(TURN) == 1) & (F.col("_sent") == 1))
        put(out.select("job_id", "seq", "status", "ts", "version"), base, "out", number)
        last = F.max_by("status", F.struct(*ORDER)).alias("status")
        kept = rows.groupBy("job_id").agg(last, F.sum("_sent").alias("sent"))
        state.write(kept.withColumn("gone", F.lit(False)), number)
        rows.unpersist()

    return run_batches(stream, base, step, **(trigger or {}))


def canonical_schema(stream: DataFrame) -> str:
    return f"version {dict(stream.dtypes)['version']}, store_name string, canonical bigint"


def stream_canonical(
    stream: DataFrame, base: str, fold_every: int = FOLD_EVERY, trigger: dict | None = None, **sizes
) -> StreamingQuery:
    """Start a query that puts (version, store_name, canonical) out: which submission's job each
    submission ends up with.

    Takes (version, store_name, kind, ts). A store name carries the submission of its job while it
    has one.
    """
    spark, types = stream.sparkSession, dict(stream.dtypes)
    columns = f"store_name string, version {types['version']}"
    state = KeyedState(spark, base, "store_name", columns, fold_every)

    def step(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col("kind").isin(SUBMIT, FAILED, DELETE))
        new = new.select(F.lit(1).alias(TURN), "store_name", "kind", "ts", "version")
        carried = state.carried(new, number).withColumns({TURN: F.lit(0), "kind": F.lit(SUBMIT)})
        rows = new.unionByName(carried, allowMissingColumns=True)
        rows = owned(rows, "version", ORDER, **sizes).persist()
        out = rows.where((F.col(TURN) == 1) & (F.col("kind") == SUBMIT))
        put(out.select("version", "store_name", "canonical"), base, "out", number)
        last = F.max_by(F.struct("kind", "canonical"), F.struct(*ORDER)).alias("_last")
        kept = rows.groupBy("store_name").agg(last).select(
            "store_name",
            F.col("_last.canonical").alias("version"),
            (F.col("_last.kind") != SUBMIT).alias("gone"),
        )
        state.write(kept, number)
        rows.unpersist()

    return run_batches(stream, base, step, **(trigger or {}))


def upsert_stream(
    stream: DataFrame, path: str, key: str, checkpoint: str, merge_every: int = 32, **trigger
):
    """Start a query that keeps the latest row per key in a versioned table at `path`.

    A batch adds only its own latest rows; every `merge_every` batches they are folded into one.
    A batch that runs again changes nothing. Batch numbers belong to a checkpoint: those of another
    one are added under versions of their own, and rows that are in already stay the latest.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = snapshots.live_parts(spark, path)
        own = [p for p in map(snapshots.part_writer, parts) if p.startswith(f"{writer}.")]
        if any(int(p.split(".")[1]) >= batch_id for p in own):
            return
        version, mark = snapshots.next_version(spark, path), f"{writer}.{batch_id}"
        snapshots.append_part(latest_by(batch, key), path, version, mark)
        if len(parts) + 1 >= merge_every:
            rows = read_upserts(spark, path, key)
            snapshots.write_record_store(rows, path, version, mark)

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserts(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Latest row per key of what `upsert_stream` has published."""
    rows = snapshots.read_parts(spark, path)
    return None if rows is None else latest_by(rows, key)
