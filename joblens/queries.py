"""Every operator as a query over the given tables."""

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens import fixtures
from joblens.operators import delivery, logs, lookups, resolve, state
from joblens.session import scratch_dir
from joblens.sources import completed, records, results, snapshots
from joblens.streaming import batches
from joblens.streaming import delivery as live_delivery
from joblens.streaming import logs as live_logs
from joblens.streaming import run
from joblens.streaming import state as live_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MOBILE_HOST = "m.youtube.com"
HISTORY_FROM_MS = 1_704_067_200_000 + 500_000
HISTORY_TO_MS = 1_704_067_200_000 + 95_000_000
SUBSCRIBED_AT = "2024-01-01 00:00:03"
ENTRIES_PER_FILE = 10_000
NESTED_BYTES = 500
PART_BYTES = 3_000
PIECE_BYTES = 997
EVENT_BATCHES = 2
SUBSCRIPTION_BATCHES = 4


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, name)


def stream_view(spark: SparkSession, sf_dir: str, name: str, base: str) -> DataFrame:
    stream = run.read_table_stream(spark, f"{sf_dir}/{base}.parquet")
    return fixtures.view(spark, sf_dir, name, **{base: stream})


# Submissions


@query
def validate_submissions(spark, sf_dir):
    rows = resolve.check_submissions(view(spark, sf_dir, "submissions_fx"), "request_video")
    return rows.select("submission_id", "request_video", "error_code")


@query
def normalize_urls(spark, sf_dir):
    rows = resolve.normalize_urls(view(spark, sf_dir, "submissions_fx"))
    return rows.select("submission_id", "url")


@query
def explode_path_parts(spark, sf_dir):
    return resolve.explode_path_parts(table(spark, sf_dir, "pages"), "page_id")


@query
def explode_query_params(spark, sf_dir):
    return resolve.check_query_params(table(spark, sf_dir, "pages"), "page_id")


@query
def resolve_video_ids(spark, sf_dir):
    rows = resolve.match_videos(view(spark, sf_dir, "submissions_fx"))
    return rows.select("submission_id", "provider", "id", "error_code")


@query
def dispatch_providers(spark, sf_dir):
    resolved, _ = resolve.dispatch_providers(view(spark, sf_dir, "submissions_fx"))
    return resolved.select("submission_id", "provider", "id")


def mobile_ids(addresses: pa.Array, hosts: pa.Array, queries: pa.Array) -> pa.Array:
    """Ids of a second provider, with Arrow's own functions."""
    found = pc.extract_regex(queries, r"(?:^|&)v=(?P<id>[^&]*)")
    ids = pc.struct_field(found, "id")
    return pc.if_else(pc.fill_null(pc.equal(hosts, MOBILE_HOST), False), ids, pa.scalar(None, pa.string()))


@query
def dispatch_vectorised(spark, sf_dir):
    """Two providers: a rule of columns, and one over Arrow arrays for what it does not match."""
    rules = [resolve.youtube_rule, resolve.vectorised_rule("mobile", mobile_ids)]
    resolved, _ = resolve.dispatch_providers(view(spark, sf_dir, "submissions_fx"), rules)
    return resolved.select("submission_id", "provider", "id")


def named_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, _ = resolve.dispatch_providers(view(spark, sf_dir, "submissions_fx"))
    return resolve.with_store_name(resolved)


@query
def with_store_name(spark, sf_dir):
    return named_submissions(spark, sf_dir).select("submission_id", "store_name")


@query
def assign_job_ids(spark, sf_dir):
    asked = view(spark, sf_dir, "submissions_fx").select("submission_id", "ts")
    rows = resolve.assign_job_ids(asked, seed="s")
    return rows.select("submission_id", "job_id")


# Finished runs


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.classify_outcomes(view(spark, sf_dir, "results_fx"))


@query
def classify_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("version", "status", "failure_reason", "error_code")


@query
def build_completed(spark, sf_dir):
    return resolve.build_completed(outcomes(spark, sf_dir))


@query
def split_cached(spark, sf_dir):
    submissions = named_submissions(spark, sf_dir).select("submission_id", "store_name")
    return state.with_cached(submissions, resolve.build_completed(outcomes(spark, sf_dir)))


# Logs and events


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.split_log_events(view(spark, sf_dir, "logs_fx"))


@query
def split_log_events(spark, sf_dir):
    return log_events(spark, sf_dir)


@query
def fold_terminal(spark, sf_dir):
    return logs.fold_terminal(log_events(spark, sf_dir))


@query
def assemble_raw_output(spark, sf_dir):
    return logs.assemble_raw_output(log_events(spark, sf_dir), segment_bytes=PART_BYTES)


@query
def raw_output_of(spark, sf_dir):
    """Looks up every job, and as many that do not exist."""
    jobs = table(spark, sf_dir, "documents").select(F.explode(F.array("doc_id", F.col("doc_id") + 10**9)).alias("id"))
    parts = logs.assemble_raw_output(log_events(spark, sf_dir), segment_bytes=PART_BYTES)
    return lookups.property_parts(jobs, parts, "raw_output")


@query
def nest_events(spark, sf_dir):
    nested = records.nest_events(view(spark, sf_dir, "event_log_fx"), segment_bytes=NESTED_BYTES)
    texts = F.transform("events", lambda e: F.concat_ws("|", e["seq"], e["name"], e["data"]))
    return nested.select("job_id", "segment", F.array_join(texts, "\n").alias("events"))


@query
def unnest_events(spark, sf_dir):
    nested = records.nest_events(view(spark, sf_dir, "event_log_fx"), segment_bytes=NESTED_BYTES)
    return records.unnest_events(nested)


@query
def number_events(spark, sf_dir):
    changes = view(spark, sf_dir, "job_changes_fx").select("job_id", "ts", "version")
    return logs.number_events(changes, ["ts", "version"]).select("job_id", "version", "seq")


@query
def status_transitions(spark, sf_dir):
    rows = logs.status_transitions(view(spark, sf_dir, "statuses_fx"), ["ts", "version"])
    return rows.select("job_id", "version", "status")


# Job state


@query
def latest_by_id(spark, sf_dir):
    rows = state.latest_by_id(view(spark, sf_dir, "job_changes_fx"))
    return rows.select("job_id", "store_name", "kind", "version")


@query
def latest_by_store(spark, sf_dir):
    rows = state.latest_by_store(view(spark, sf_dir, "job_changes_fx"))
    return rows.select("store_name", "job_id", "kind", "version")


@query
def assign_canonical(spark, sf_dir):
    return state.assign_canonical(view(spark, sf_dir, "job_changes_fx"))


@query
def stale_results(spark, sf_dir):
    changes = view(spark, sf_dir, "job_changes_fx")
    return state.stale_results(changes, view(spark, sf_dir, "files_fx"))


@query
def stale_disconnected(spark, sf_dir):
    """The dedup view is an old one; some of its jobs are gone and asked for again."""
    changes = view(spark, sf_dir, "job_changes_fx")
    old = state.latest_by(changes.where("kind <> 'DELETE' and version % 4 = 0"), "store_name")
    gone = state.audit_disconnects(old, state.latest_by_id(changes))
    return state.stale_results(changes.where("version % 4 <> 1"), view(spark, sf_dir, "files_fx"), gone)


@query
def audit_disconnects(spark, sf_dir):
    """The dedup view missed the deletes that the primary view saw."""
    changes = view(spark, sf_dir, "job_changes_fx")
    by_store = state.latest_by(changes.where("kind <> 'DELETE'"), "store_name")
    rows = state.audit_disconnects(by_store, state.latest_by_id(changes))
    return rows.select("store_name", "job_id")


@query
def purge_resubmit(spark, sf_dir):
    by_store = state.latest_by_store(view(spark, sf_dir, "job_changes_fx"))
    return state.purge_resubmit(by_store, "kind").select("store_name", "job_id", "version")


@query
def active_jobs(spark, sf_dir):
    rows = state.active_jobs(view(spark, sf_dir, "job_changes_fx"))
    return rows.select("job_id", "store_name", "version")


@query
def cascade_delete(spark, sf_dir):
    """Deletes the failed jobs and some ids that do not exist."""
    jobs = view(spark, sf_dir, "jobs_fx")
    lookups_fx = view(spark, sf_dir, "lookups_fx")
    failed = jobs.where("status = 'FAILED'").select("id")
    ids = failed.unionByName(lookups_fx.join(jobs, "id", "left_anti"))
    by_store = state.latest_by_store(view(spark, sf_dir, "job_changes_fx"))
    left = state.cascade_marks(
        ids,
        jobs,
        by_store,
        resolve.build_completed(outcomes(spark, sf_dir)),
        view(spark, sf_dir, "files_fx"),
    )
    names = ["by_store.store_name", "completed.store_name", "files.store_name", "by_id.id", "not_found"]
    return left.select("view", F.coalesce(*names).alias("key"))


# Delivery


@query
def resume_offsets(spark, sf_dir):
    rows = delivery.check_resume_offsets(view(spark, sf_dir, "subscriptions_fx"))
    return rows.select("subscriber", "job_id", "skip", "error_code")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, _ = delivery.resume_offsets(view(spark, sf_dir, "subscriptions_fx"))
    return delivery.replay(wanted, view(spark, sf_dir, "event_log_fx"))


@query
def replay(spark, sf_dir):
    return replayed(spark, sf_dir)


@query
def dedupe_delivery(spark, sf_dir):
    """A subscriber that reconnects gets its backlog twice; status events carry no id here."""
    sent = replayed(spark, sf_dir).where("job_found").drop("job_found")
    no_id = sent.withColumn("seq", F.when(F.col("name") != "status", F.col("seq")))
    twice = no_id.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))
    return delivery.dedupe_delivery(twice, "arrival").drop("arrival")


# Questions


@query
def with_end_time(spark, sf_dir):
    rows = lookups.with_end_time(view(spark, sf_dir, "jobs_fx"), view(spark, sf_dir, "files_fx"))
    return rows.select("id", "end_ms")


@query
def parse_range(spark, sf_dir):
    rows = lookups.check_ranges(view(spark, sf_dir, "range_args_fx"), "from_text", "to_text")
    return rows.select("request_id", "from_ms", "to_ms", "error_code")


@query
def history(spark, sf_dir):
    jobs, files = view(spark, sf_dir, "jobs_fx"), view(spark, sf_dir, "files_fx")
    rows, _ = lookups.history(jobs, files, HISTORY_FROM_MS, HISTORY_TO_MS)
    return rows


@query
def history_ranges(spark, sf_dir):
    jobs, files = view(spark, sf_dir, "jobs_fx"), view(spark, sf_dir, "files_fx")
    return lookups.history_ranges(view(spark, sf_dir, "ranges_fx"), jobs, files)


@query
def status_of(spark, sf_dir):
    return lookups.status_of(view(spark, sf_dir, "lookups_fx"), view(spark, sf_dir, "jobs_fx"))


@query
def property_of(spark, sf_dir):
    ids, jobs = view(spark, sf_dir, "lookups_fx"), view(spark, sf_dir, "jobs_fx")
    return lookups.property_of(ids, jobs, "file_name")


@query
def export_manifest(spark, sf_dir):
    ids, jobs = view(spark, sf_dir, "lookups_fx"), view(spark, sf_dir, "jobs_fx")
    return lookups.export_manifest(ids, jobs, view(spark, sf_dir, "files_fx"))


@query
def progress_view(spark, sf_dir):
    changed = logs.status_transitions(view(spark, sf_dir, "statuses_fx"), ["ts", "version"])
    events = logs.status_events(changed).withColumnRenamed("version", "seq")
    return lookups.progress_view(events)


@query
def progress_of_submitted(spark, sf_dir):
    changed = logs.status_transitions(view(spark, sf_dir, "statuses_fx"), ["ts", "version"])
    events = logs.status_events(changed).withColumnRenamed("version", "seq")
    submitted = view(spark, sf_dir, "job_changes_fx").where("kind = 'SUBMIT'")
    return lookups.progress_view(events, submitted=submitted)


# Storage


@query
def scan_results(spark, sf_dir):
    """A result file per supplier."""
    path = scratch_dir(spark, "results")
    files = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("store_name"), F.concat_ws(" ", "s_name", "s_suppkey").alias("value")
    )
    files.repartition("store_name").write.partitionBy("store_name").text(path)
    return results.scan_results(spark, path, in_folders=True).select("store_name", "length")


@query
def duplicate_files(spark, sf_dir):
    return results.duplicate_files(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def read_record_store(spark, sf_dir):
    """Snapshots of the change log; deletes lack a video and failures carry an unknown field."""
    changes = view(spark, sf_dir, "job_changes_fx")
    entry = F.to_json(
        F.struct(
            F.col("job_id").alias("id"),
            F.when(F.col("kind") != "DELETE", F.col("store_name")).alias("video"),
            F.when(F.col("kind") == "SUBMIT", "CREATED")
            .when(F.col("kind") != "DELETE", F.col("kind"))
            .alias("status"),
            F.col("version").alias("process"),
            F.when(F.col("kind") == "FAILED", F.lit(1)).alias("extra"),
        )
    )
    field = F.concat(F.lit('"'), F.col("version").cast("string"), F.lit('" : '), entry)
    files = (
        changes.select(
            F.floor(F.col("version") / ENTRIES_PER_FILE).alias("file"), field.alias("field")
        )
        .groupBy("file")
        .agg(F.array_join(F.collect_list("field"), ",\n  ").alias("fields"))
        .select("file", F.concat(F.lit("{\n  "), "fields", F.lit("\n}")).alias("value"))
    )
    path = scratch_dir(spark, "snapshots")
    files.write.partitionBy("file").text(path)
    rows, bad = records.read_record_store(spark, f"{path}/*/*.txt")
    rows = rows.unionByName(bad, allowMissingColumns=True)
    return rows.select(
        F.col("key").cast("bigint").alias("version"), "id", "video", "status", "process", "error_code"
    )


@query
def write_record_store(spark, sf_dir):
    path = scratch_dir(spark, "record-store")
    rows = state.latest_by_id(view(spark, sf_dir, "job_changes_fx"))
    snapshots.write_record_store(rows, path)
    return snapshots.read_parts(spark, path).select("job_id", "store_name", "kind", "version")


@query
def append_completed(spark, sf_dir):
    """Puts every completed record, then removes those of store names without a file."""
    path = scratch_dir(spark, "completed")
    built = resolve.build_completed(outcomes(spark, sf_dir))
    completed.append_completed(built, path)
    gone = built.join(view(spark, sf_dir, "files_fx"), "store_name", "left_anti")
    completed.remove_completed(gone, path)
    return completed.read_completed(spark, path)


@query
def encode_records(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs_fx")
    return records.encode_records(jobs.select("id", "status", "failure_reason", "version"))


@query
def decode_records(spark, sf_dir):
    """Failed jobs are written with a text where a number belongs."""
    jobs = view(spark, sf_dir, "jobs_fx").select("id", "status", "file_name", "version")
    good = records.encode_records(jobs.where("status <> 'FAILED'"))
    bad = records.encode_records(jobs.where("status = 'FAILED'").withColumn("version", F.lit("?")))
    schema = T.StructType.fromDDL("id string, status string, file_name string, version bigint")
    rows, rejected = records.decode_records(good.unionByName(bad), schema)
    named = rejected.select(
        F.get_json_object("record", "$.id").alias("id"), "error_code"
    )
    return rows.unionByName(named, allowMissingColumns=True)


# Streams


@query
def stream_transitions(spark, sf_dir):
    changes = stream_view(spark, sf_dir, "statuses_fx", "events")
    schema = live_state.transitions_schema(changes)
    rows = batches.drain_batches(changes, "transitions", live_state.stream_transitions, schema)
    return rows.select("job_id", "seq", "status", "version")


@query
def stream_canonical(spark, sf_dir):
    changes = stream_view(spark, sf_dir, "job_changes_fx", "events")
    schema = live_state.canonical_schema(changes)
    return batches.drain_batches(changes, "canonical", live_state.stream_canonical, schema)


def log_pieces(logs_fx: DataFrame, size: int = PIECE_BYTES) -> DataFrame:
    """Logs as byte pieces, cut without regard to lines or characters."""
    raw = F.encode("log", "utf-8")
    cut = logs_fx.select("job_id", raw.alias("raw")).withColumn(
        "last", F.greatest(F.floor((F.octet_length("raw") - 1) / size), F.lit(0))
    )
    return cut.select(
        "job_id", "raw", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("part")
    ).select(
        "job_id",
        "part",
        F.substring("raw", (F.col("part") * size + 1).cast("int"), F.lit(size)).alias("piece"),
        (F.col("part") == F.col("last")).alias("is_last"),
    )


@query
def stream_split_logs(spark, sf_dir):
    pieces = log_pieces(stream_view(spark, sf_dir, "logs_fx", "documents"))
    schema = live_logs.log_events_schema(pieces)
    return batches.drain_batches(pieces, "split-logs", live_logs.stream_split_logs, schema)


@query
def upsert_stream(spark, sf_dir):
    base = scratch_dir(spark, "upserts")
    changes = stream_view(spark, sf_dir, "job_changes_fx", "events")
    running = live_state.upsert_stream(changes, f"{base}/table", "job_id", f"{base}/checkpoint")
    running.awaitTermination()
    rows = live_state.read_upserts(spark, f"{base}/table", "job_id")
    return rows.select("job_id", "store_name", "kind", "version")


def subscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, _ = delivery.resume_offsets(view(spark, sf_dir, "subscriptions_fx"))
    return wanted.withColumn("subscribed_at", F.lit(SUBSCRIBED_AT).cast("timestamp"))


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_view(spark, sf_dir, "live_log_fx", "conversations")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    return live_delivery.follow(log, subscribed(spark, sf_dir))


@query
def replay_and_tail(spark, sf_dir):
    """Events come in EVENT_BATCHES batches, subscriptions in more: some before the events of their
    job, some in between, some after all events."""
    log = view(spark, sf_dir, "live_log_fx").withColumn("ts", F.col("ts").cast("timestamp"))
    events = run.in_batches(log, F.pmod("seq", F.lit(EVENT_BATCHES)), EVENT_BATCHES, "events")
    asked = subscribed(spark, sf_dir)
    turn = F.pmod(F.col("subscriber") / 10, F.lit(SUBSCRIPTION_BATCHES))
    asked = run.in_batches(asked, turn, SUBSCRIPTION_BATCHES, "subscriptions")
    jobs = view(spark, sf_dir, "event_log_fx").select("job_id").distinct()
    base = scratch_dir(spark, "tail")
    live_delivery.replay_and_tail(events, asked, base, jobs).awaitTermination()
    rows = batches.stored(spark, base, "out", live_delivery.deliveries_schema(events, asked))
    return rows.drop("batch", "ts")


@query
def stream_dedupe_delivery(spark, sf_dir):
    """Everything arrives twice; status events carry no id here."""
    sent = tailed(spark, sf_dir).drop("ts")
    no_id = sent.withColumn("seq", F.when(F.col("name") != "status", F.col("seq")))
    twice = no_id.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run.drain(live_delivery.stream_dedupe_delivery(twice), "delivered")
