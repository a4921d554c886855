"""Job state from a log of changes."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblens.plans.ordered import Chunks
from joblens.schemas import CONVERTING, DELETE, FAILED, SUBMIT, SUCCESSFUL

ORDER = ["ts", "version"]


def latest_by(changes: DataFrame, key: str, order: list[str] = ORDER) -> DataFrame:
    """Last change of each key. Map tasks keep one row per key before anything is shuffled."""
    rest = [name for name in changes.columns if name != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy(key).agg(last).select(key, "_last.*")


def latest_by_id(changes: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Primary view: the last change of each job that was not deleted."""
    return latest_by(changes, job_id).where(F.col("kind") != DELETE)


def latest_by_store(changes: DataFrame) -> DataFrame:
    """Dedup view: the last change of each store name that was not deleted."""
    return latest_by(changes, "store_name").where(F.col("kind") != DELETE)


def _life_cycle(changes: DataFrame, columns: list[str]) -> DataFrame:
    return changes.where(F.col("kind").isin(SUBMIT, FAILED, DELETE)).select(*columns)


def owned(
    changes: DataFrame, submission: str, order: list[str] = ORDER, **sizes
) -> DataFrame:
    """Submissions, failures and deletes in order, with the submission whose job is the latest."""
    chunks = Chunks(changes, ["store_name"], order, **sizes)
    ordered, at = chunks.ordered(), chunks.at()
    is_submit = F.col("kind") == SUBMIT
    rows = chunks.rows.withColumns(
        {
            "_previous": F.lag("kind").over(ordered),
            "_first": F.first(F.struct("kind", F.col(submission).alias("of"))).over(ordered),
        }
    )
    # Whether the first row of a chunk starts a job depends on the chunk before.
    inner = F.when(is_submit & (F.col("_previous") != SUBMIT), F.col(submission))
    rows = rows.withColumn("_started", inner)
    rows = rows.withColumn("_latest", F.last("_started", ignorenulls=True).over(ordered))
    first_start = F.when(
        (F.col("_first.kind") == SUBMIT) & F.coalesce(F.col("_last_kind") != SUBMIT, F.lit(True)),
        F.col("_first.of"),
    )
    rows = chunks.with_neighbours(
        rows,
        {
            "_kind": F.max_by("kind", at),
            "_inner": F.max_by("_started", F.when(F.col("_started").isNotNull(), at)),
            "_first": F.min_by("_first", at),
        },
        lambda over: {
            "_last_kind": F.col("_last_kind"),
            "_owner": F.last(F.coalesce("_inner", first_start), ignorenulls=True).over(
                over.rowsBetween(Window.unboundedPreceding, -1)
            ),
        },
        lambda over: {"_last_kind": F.lag("_kind").over(over)},
    )
    rows = rows.withColumn("canonical", F.coalesce("_latest", first_start, "_owner"))
    return chunks.done(rows).drop(
        "_previous", "_first", "_started", "_latest", "_last_kind", "_owner"
    )


def assign_canonical(changes: DataFrame, submission: str = "version", **sizes) -> DataFrame:
    """(submission, store_name, canonical): the submission whose job each submission ends up with.

    A submission starts a job when it comes first or follows a failure or a delete; otherwise it
    reuses the job started last.
    """
    columns = list(dict.fromkeys(["store_name", "kind", *ORDER, submission]))
    rows = owned(_life_cycle(changes, columns), submission, **sizes)
    return rows.where(F.col("kind") == SUBMIT).select(submission, "store_name", "canonical")


def stale_stores(changes: DataFrame, **sizes) -> DataFrame:
    """Store names for which some submission found a failed job."""
    columns = ["store_name", "kind", *ORDER]
    chunks = Chunks(_life_cycle(changes, columns), ["store_name"], ORDER, **sizes)
    # A failure counts only while there is a job: after a submission, not after a delete.
    ordered, at = chunks.ordered(), chunks.at()
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.rows.withColumn("_ends", F.when(F.col("kind") != FAILED, F.col("kind")))
    rows = rows.withColumns(
        {
            "_previous": F.lag("kind").over(ordered),
            "_owner": F.last("_ends", ignorenulls=True).over(earlier),
        }
    )
    rows = chunks.with_neighbours(
        rows,
        {
            "_kind": F.max_by("kind", at),
            "_end": F.max_by("_ends", F.when(F.col("_ends").isNotNull(), at)),
        },
        lambda over: {
            "_last_kind": F.lag("_kind").over(over),
            "_last_owner": F.last("_end", ignorenulls=True).over(
                over.rowsBetween(Window.unboundedPreceding, -1)
            ),
        },
    )
    after_failure = F.coalesce("_previous", "_last_kind") == FAILED
    had_job = F.coalesce("_owner", "_last_owner") == SUBMIT
    return rows.where((F.col("kind") == SUBMIT) & after_failure & had_job).select("store_name").distinct()


def stale_results(
    changes: DataFrame,
    files: DataFrame,
    disconnected: DataFrame | None = None,
    **sizes,
) -> DataFrame:
    """Result files to delete. Only lists them.

    `disconnected` (see `audit_disconnects`) adds the store names whose job has gone missing and
    which were submitted again after that entry.
    """
    stores = stale_stores(changes, **sizes)
    if disconnected is not None:
        submitted = (
            changes.where(F.col("kind") == SUBMIT)
            .groupBy("store_name")
            .agg(F.max(F.struct(*ORDER)).alias("_submitted"))
        )
        again = disconnected.join(submitted, "store_name").where(
            F.col("_submitted") > F.struct(*[disconnected[c] for c in ORDER])
        )
        stores = stores.unionByName(again.select("store_name")).distinct()
    return files.join(stores, "store_name", "left_semi")


def audit_disconnects(
    by_store: DataFrame, by_id: DataFrame, job_id: str = "job_id"
) -> DataFrame:
    """Dedup-view entries whose job the primary view does not have."""
    return by_store.join(by_id.select(job_id), job_id, "left_anti")


def with_cached(submissions: DataFrame, completed: DataFrame) -> DataFrame:
    """Add `file_name` and `status` of a completed record, null where there is none.

    Many submissions of one store name are split over tasks by adaptive execution.
    """
    records = completed.select("store_name", "file_name", F.lit(SUCCESSFUL).alias("status"))
    return submissions.join(records, "store_name", "left")


def split_cached(submissions: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses). A hit is SUCCESSFUL at once; whether its file exists is not looked at."""
    rows = with_cached(submissions, completed)
    hit = F.col("status").isNotNull()
    return rows.where(hit), rows.where(~hit).drop("file_name", "status")


def classify_outcomes(results: DataFrame) -> DataFrame:
    """Add `status`, `failure_reason` and `error_code` of finished runs.

    A run without an exit code or an exception has no status, and an `error_code` instead.
    """
    reason = (
        F.when(
            F.col("exception_text").isNotNull(), F.concat(F.lit("Error: "), F.col("exception_text"))
        )
        .when(
            F.col("exit_code") != 0,
            F.concat(F.lit("Bad Exit Code "), F.col("exit_code").cast("string")),
        )
        .when(F.col("result_name").isNull(), "Error: no result given")
    )
    unknown = F.col("exit_code").isNull() & F.col("exception_text").isNull()
    return results.withColumns(
        {
            "failure_reason": F.when(~unknown, reason),
            "status": F.when(~unknown, F.when(reason.isNull(), SUCCESSFUL).otherwise(FAILED)),
            "error_code": F.when(unknown, "exit_code.missing"),
        }
    )


def purge_resubmit(by_store: DataFrame, status: str = "status") -> DataFrame:
    """Dedup-view entries that survive a restart."""
    return by_store.where(F.col(status).eqNullSafe(SUCCESSFUL))


def active_jobs(changes: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Jobs still running."""
    return latest_by_id(changes, job_id).where(F.col("kind") == CONVERTING)


class AfterDelete(NamedTuple):
    by_id: DataFrame
    by_store: DataFrame
    completed: DataFrame
    files: DataFrame
    not_found: DataFrame


def cascade_marks(
    ids: DataFrame, by_id: DataFrame, by_store: DataFrame, completed: DataFrame, files: DataFrame
) -> DataFrame:
    """(view, by_id, by_store, completed, files, not_found): every row that is left, as a struct in
    the column of its view, and the ids that do not exist.

    Two aggregates over tagged rows: one marks ids, one marks the store names of the ids found.
    """
    empty = {"_asked": F.lit(False), "_row": F.lit(None).cast(by_id.schema)}
    jobs = ids.select("id", F.lit(True).alias("_asked"), empty["_row"].alias("_row")).unionByName(
        by_id.select("id", empty["_asked"].alias("_asked"), F.struct("*").alias("_row"))
    )
    jobs = jobs.groupBy("id").agg(
        F.bool_or("_asked").alias("_asked"), F.collect_list("_row").alias("_rows")
    )
    stores = {"by_store": by_store, "completed": completed, "files": files}
    kept = {name: F.lit(None).cast(rows.schema).alias(name) for name, rows in stores.items()}
    no_id = F.lit(None).cast(by_id.schema["id"].dataType).alias("not_found")
    gone = jobs.where("_asked").select(F.explode("_rows").alias("_row"))
    tagged = gone.select(
        F.col("_row.store_name").alias("store_name"), F.lit(True).alias("_gone"), *kept.values()
    )
    for name, rows in stores.items():
        columns = kept | {name: F.struct("*").alias(name)}
        tagged = tagged.unionByName(rows.select("store_name", F.lit(False).alias("_gone"), *columns.values()))
    by_name = tagged.groupBy("store_name").agg(
        F.bool_or("_gone").alias("_gone"), *[F.collect_list(name).alias(name) for name in stores]
    )
    no_job = F.lit(None).cast(by_id.schema).alias("by_id")

    def of_view(name: str):
        """Entries of one view as rows of all views."""
        others = {other: F.lit(None).cast(rows.schema).alias(other) for other, rows in stores.items()}
        return lambda entry: F.struct(
            F.lit(name).alias("view"), *(others | {name: entry.alias(name)}).values()
        )

    left = [F.transform(name, of_view(name)) for name in stores]
    stores_left = by_name.where("not _gone").select(F.inline(F.concat(*left)))
    found = F.size("_rows") > 0
    # each branch asks for both columns, so that all read one exchange
    rows_left = jobs.where(~F.col("_asked") & found).select(
        F.lit("by_id").alias("view"), F.explode("_rows").alias("by_id"), *kept.values(), no_id
    )
    missing = jobs.where(F.col("_asked") & ~found).select(
        F.lit("not_found").alias("view"), no_job, *kept.values(), F.col("id").alias("not_found")
    )
    return rows_left.unionByName(missing).unionByName(
        stores_left.select("view", no_job, *stores, no_id)
    )


def cascade_delete(
    ids: DataFrame, by_id: DataFrame, by_store: DataFrame, completed: DataFrame, files: DataFrame
) -> AfterDelete:
    """What is left after deleting the jobs in `ids`, and the ids that do not exist.

    A deleted job takes its store name's dedup entry, completed record and file with it. Other jobs
    of the same store name stay in the primary view.
    """
    marks = cascade_marks(ids, by_id, by_store, completed, files)

    def part(name: str) -> DataFrame:
        return marks.where(F.col("view") == name).select(f"{name}.*")

    missing = marks.where("view = 'not_found'").select(F.col("not_found").alias("id"))
    return AfterDelete(part("by_id"), part("by_store"), part("completed"), part("files"), missing)
