"""Streaming delivery to subscribers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joblens.streaming.batches import put, run_batches, stored

EVENT = ["job_id", "seq", "name", "data", "ts"]
SUBSCRIPTION = ["subscriber", "job_id", "skip", "subscribed_at"]


def is_due() -> Column:
    """`skip` holds for the backlog only: what is newer than `subscribed_at` is sent in any case."""
    return (F.col("seq") >= F.col("skip")) | (F.col("ts") >= F.col("subscribed_at"))


def follow(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, job_id, seq, name, data, ts) from the start of a stream, for subscriptions that
    are all known before."""
    wanted = subscriptions.select(*SUBSCRIPTION)
    return stream.join(wanted, "job_id").where(is_due()).select("subscriber", *EVENT)


def deliveries_schema(events: DataFrame, subscriptions: DataFrame) -> str:
    types = dict(events.dtypes) | dict(subscriptions.dtypes)
    columns = ", ".join(f"{name} {types[name]}" for name in ("subscriber", *EVENT))
    return f"{columns}, job_found boolean"


def replay_and_tail(
    events: DataFrame,
    subscriptions: DataFrame,
    base: str,
    jobs: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that puts (subscriber, job_id, seq, name, data, ts, job_found) out, from a stream
    of events and a stream of subscriptions.

    Events go to a stored log. A subscription is handed over at the batch it comes in: what the log
    holds up to and with that batch is its backlog, what later batches bring its tail, so every due
    event is sent once, whether it came before the subscription or after. A subscription of a job that
    neither the log nor `jobs` (job_id) has by then gives one row without an event.

    A batch without new subscriptions does not read the log of earlier ones.
    """
    spark = events.sparkSession
    event_types, types = dict(events.dtypes), dict(subscriptions.dtypes)
    log_schema = ", ".join(f"{name} {event_types[name]}" for name in EVENT)
    asked_schema = ", ".join(f"{name} {types[name]}" for name in SUBSCRIPTION) + ", job_found boolean"
    both = events.select(
        F.struct(*EVENT).alias("event"), F.lit(None).cast(_struct(subscriptions)).alias("asked")
    ).unionByName(
        subscriptions.select(
            F.lit(None).cast(_struct(events)).alias("event"), F.struct(*SUBSCRIPTION).alias("asked")
        )
    )

    def step(batch: DataFrame, number: int) -> None:
        put(batch.where("event is not null").select("event.*"), base, "log", number)
        log = stored(spark, base, "log", log_schema).where(F.col("batch") <= number)
        asked = batch.where("asked is not null").select("asked.*")
        known = log.select("job_id")
        if jobs is not None:
            known = known.unionByName(jobs.select("job_id"))
        known = known.join(asked.select("job_id"), "job_id", "left_semi").distinct()
        found = known.withColumn("job_found", F.lit(True))
        asked = asked.join(found, "job_id", "left").withColumn(
            "job_found", F.coalesce("job_found", F.lit(False))
        )
        put(asked.select(*SUBSCRIPTION, "job_found"), base, "asked", number)
        stored_asked = stored(spark, base, "asked", asked_schema)
        earlier = stored_asked.where((F.col("batch") < number) & F.col("job_found"))
        out = _sent(log.where(F.col("batch") == number), earlier)
        new = stored_asked.where(F.col("batch") == number)
        if not new.isEmpty():
            out = out.unionByName(_sent(log, new.where("job_found")))
            refused = new.where("not job_found").select("subscriber", "job_id", "job_found")
            out = out.unionByName(refused, allowMissingColumns=True)
        put(out, base, "out", number)

    return run_batches(both, base, step, **(trigger or {}))


def _struct(rows: DataFrame) -> str:
    names = EVENT if "seq" in rows.columns else SUBSCRIPTION
    return "struct<" + ",".join(f"{name}:{dict(rows.dtypes)[name]}" for name in names) + ">"


def _sent(log: DataFrame, asked: DataFrame) -> DataFrame:
    """Due events. Adaptive execution splits a job of many events, or of many subscribers."""
    pairs = log.select(*EVENT).join(asked.select(*SUBSCRIPTION), "job_id").where(is_due())
    return pairs.select("subscriber", *EVENT, F.lit(True).alias("job_found"))


def stream_dedupe_delivery(stream: DataFrame, within: str | None = None) -> DataFrame:
    """Each event once per subscriber, the first to arrive; events without an id all stay.

    State grows with the events delivered. `within` (a watermark delay on `ts`) bounds it and gives
    up on copies that come later than that.
    """
    key = ["subscriber", "job_id", "seq"]
    with_id = stream.where(F.col("seq").isNotNull())
    if within is None:
        kept = with_id.dropDuplicates(key)
    else:
        kept = with_id.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)
    return kept.unionByName(stream.where(F.col("seq").isNull()))
