"""Replay of stored events to subscribers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblens.operators.resolve import split_errors
from joblens.plans.blocks import floor_div

INT_MAX = 2**31 - 1

# Events of one job are joined to its subscribers this many at a time.
CHUNK_EVENTS = 65_536


def check_resume_offsets(subscriptions: DataFrame) -> DataFrame:
    """Add `skip` (position of the first event to send) and `error_code`.

    A missing or malformed id starts from the beginning; one whose successor is negative or does
    not fit an int is an error.
    """
    text = F.col("last_event_id")
    last = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int")).cast("bigint")
    skip = F.coalesce(last + 1, F.lit(0).cast("bigint"))
    return subscriptions.withColumn("skip", skip).withColumn(
        "error_code", F.when((F.col("skip") < 0) | (F.col("skip") > INT_MAX), "skip.negative")
    )


def resume_offsets(subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscriptions with `skip`, quarantine)."""
    return split_errors(check_resume_offsets(subscriptions))


def replay(
    subscriptions: DataFrame,
    events: DataFrame,
    chunk_events: int = CHUNK_EVENTS,
) -> DataFrame:
    """(subscriber, job_id, seq, name, data, job_found) for every event at or after `skip`.

    A subscriber of an unknown job gets one row without an event. Subscribers meet a job's events
    chunk by chunk, and adaptive execution splits the subscribers of a popular job, so neither a
    long log nor a popular job ends up in one task.
    """
    chunk = floor_div(F.col("seq"), chunk_events).alias("_part")
    placed = events.select("job_id", "seq", "name", "data", chunk)
    directory = placed.select("job_id", "_part").distinct()
    narrow = subscriptions.select("subscriber", "job_id", "skip")
    wanted = narrow.join(directory, "job_id", "left").where(
        F.col("_part").isNull() | (F.col("_part") >= floor_div(F.col("skip"), chunk_events))
    )
    sent = wanted.join(placed, ["job_id", "_part"], "left").where(
        F.col("_part").isNull() | (F.col("seq") >= F.col("skip"))
    )
    found = F.col("_part").isNotNull()
    return sent.select("subscriber", "job_id", "seq", "name", "data", found.alias("job_found"))


def dedupe_delivery(deliveries: DataFrame, arrival: str | None = None) -> DataFrame:
    """Each event once per subscriber, the first to arrive; events without an id all stay."""
    key = ["subscriber", "job_id", "seq"]
    with_id = deliveries.where(F.col("seq").isNotNull())
    if arrival is None:
        kept = with_id.dropDuplicates(key)
    else:
        rest = [name for name in deliveries.columns if name not in key]
        kept = (
            with_id.groupBy(*key)
            .agg(F.min_by(F.struct(*rest), arrival).alias("_event"))
            .select(*key, "_event.*")
        )
    return kept.unionByName(deliveries.where(F.col("seq").isNull()))
