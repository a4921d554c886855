"""Questions about jobs: history, status, properties, exports, progress."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblens.functions.names import content_disposition
from joblens.operators.resolve import split_errors
from joblens.plans.blocks import within_ranges
from joblens.schemas import CONVERTING, FAILED, STATUS_EVENT, SUCCESSFUL

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _as_long(text: str) -> int | None:
    if not re.fullmatch(r"[+-]?[0-9]+", text, re.ASCII):
        return None
    number = int(text)
    return number if LONG_MIN <= number <= LONG_MAX else None


def parse_range(
    from_values: Sequence[str] = (), to_values: Sequence[str] = ()
) -> tuple[int | None, int | None]:
    """Bounds in epoch milliseconds. Only the first value counts; text that is no number is ignored.

    Raises ValueError with the error code.
    """
    from_ms = _as_long(from_values[0]) if from_values else None
    if from_ms is not None and from_ms < 0:
        raise ValueError("from.too.small")
    to_ms = _as_long(to_values[0]) if to_values else None
    if from_ms is not None and to_ms is not None and to_ms < from_ms:
        raise ValueError("to.too.small")
    return from_ms, to_ms


def check_ranges(df: DataFrame, from_text: str = "from", to_text: str = "to") -> DataFrame:
    """Add `from_ms`, `to_ms` and `error_code`: `parse_range` for a table of arguments."""

    def as_long(name: str) -> Column:
        text = F.col(name)
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))

    return (
        df.withColumn("from_ms", as_long(from_text))
        .withColumn("to_ms", as_long(to_text))
        .withColumn(
            "error_code",
            F.when(F.col("from_ms") < 0, "from.too.small").when(
                F.col("to_ms") < F.col("from_ms"), "to.too.small"
            ),
        )
    )


def parse_ranges(
    df: DataFrame, from_text: str = "from", to_text: str = "to"
) -> tuple[DataFrame, DataFrame]:
    return split_errors(check_ranges(df, from_text, to_text))


def with_end_time(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Add `end_ms`: when the result file was written, 0 where there is no file."""
    ends = files.select("store_name", F.col("end_ms").alias("_end_ms"))
    joined = jobs.join(ends, "store_name", "left")
    return joined.withColumn("end_ms", F.coalesce("_end_ms", F.lit(0))).drop("_end_ms")


def ended_within(
    jobs: DataFrame, files: DataFrame, from_ms: int | None, to_ms: int | None
) -> DataFrame:
    """Jobs with `end_ms` in [from_ms, to_ms), None for no bound.

    The range is a filter on the files alone, which reaches their scan. A job without a file ended
    at 0; such jobs are looked for only if the range holds 0.
    """
    ends = files.select("store_name", "end_ms").where(F.col("end_ms").isNotNull())
    inside = ends
    if from_ms is not None:
        inside = inside.where(F.col("end_ms") >= from_ms)
    if to_ms is not None:
        inside = inside.where(F.col("end_ms") < to_ms)
    rows = jobs.join(inside, "store_name")
    if (from_ms or 0) <= 0 and (to_ms is None or to_ms > 0):
        missing = jobs.join(ends, "store_name", "left_anti")
        rows = rows.unionByName(missing.withColumn("end_ms", F.lit(0).cast("bigint")))
    return rows


def history(
    jobs: DataFrame,
    files: DataFrame,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((id, name) newest first, quarantine of rows without a file name).

    Successful jobs that ended in [from_ms, to_ms).
    """
    finished = jobs.where(F.col("status") == SUCCESSFUL).select("id", "store_name", "file_name")
    rows = ended_within(finished, files, from_ms, to_ms)
    named = rows.where(F.col("file_name").isNotNull()).orderBy(F.desc("end_ms"), "id")
    unnamed = rows.where(F.col("file_name").isNull())
    return (
        named.select("id", F.col("file_name").alias("name")),
        unnamed.withColumn("error_code", F.lit("name.missing")),
    )


def history_ranges(ranges: DataFrame, jobs: DataFrame, files: DataFrame, **options) -> DataFrame:
    """(range_id, id, name) of the successful jobs in each range of a table of ranges."""
    finished = jobs.where((F.col("status") == SUCCESSFUL) & F.col("file_name").isNotNull())
    ended = with_end_time(finished.select("id", "store_name", "file_name"), files)
    pairs = within_ranges(ended.select("id", "file_name", "end_ms"), "end_ms", ranges, **options)
    return pairs.select("range_id", "id", F.col("file_name").alias("name"))


def status_of(ids: DataFrame, by_id: DataFrame) -> DataFrame:
    """(id, status, reason, error_code) of each distinct id."""
    jobs = by_id.select("id", "status", "failure_reason")
    rows = ids.select("id").distinct().join(jobs, "id", "left")
    failed = F.col("status") == FAILED
    reason = F.col("failure_reason")
    return rows.select(
        "id",
        "status",
        F.when(failed, reason).alias("reason"),
        F.when(F.col("status").isNull(), "not_found")
        .when(failed & reason.isNull(), "reason.missing")
        .alias("error_code"),
    )


def property_of(ids: DataFrame, by_id: DataFrame, prop: str) -> DataFrame:
    """(id, value, error_code) of each distinct id; a null property counts as not found."""
    jobs = by_id.select("id", F.col(prop).alias("value")).where(F.col("value").isNotNull())
    rows = ids.select("id").distinct().join(jobs, "id", "left")
    return rows.withColumn("error_code", F.when(F.col("value").isNull(), "not_found"))


def property_parts(ids: DataFrame, parts: DataFrame, prop: str, job_id: str = "job_id") -> DataFrame:
    """(id, part, value, error_code) of each distinct id, for a property that is stored in parts; one
    row without a value where there is no part."""
    stored = parts.select(F.col(job_id).alias("id"), "part", F.col(prop).alias("value"))
    stored = stored.where(F.col("value").isNotNull())
    rows = ids.select("id").distinct().join(stored, "id", "left")
    return rows.withColumn("error_code", F.when(F.col("value").isNull(), "not_found"))


def export_manifest(ids: DataFrame, by_id: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code, error_code, status, content_length, content_disposition) of each distinct id.

    Code is 200 for a result that can be downloaded, else why not: 404 unknown, 409 failed or not
    finished, 500 for a successful job without a file or a file name.
    """
    jobs = by_id.select("id", "store_name", "status", "file_name")
    asked = ids.select("id").distinct().join(jobs, "id", "left")
    lengths = files.select("store_name", "length")
    rows = asked.join(lengths, "store_name", "left")
    status = F.col("status")
    error = (
        F.when(status.isNull(), "not_found")
        .when(status == FAILED, "conversion.failed")
        .when(status != SUCCESSFUL, "conversion.not.finished")
        .when(F.col("length").isNull(), "file.missing")
        .when(F.col("file_name").isNull(), "name.missing")
    )
    ready = F.col("error_code").isNull()
    code = (
        F.when(ready, 200)
        .when(F.col("error_code") == "not_found", 404)
        .when(F.col("error_code").startswith("conversion."), 409)
        .otherwise(500)
    )
    return rows.withColumn("error_code", error).select(
        "id",
        code.alias("code"),
        "error_code",
        F.when(F.col("error_code") == "conversion.not.finished", status).alias("status"),
        F.when(ready, F.col("length")).alias("content_length"),
        F.when(ready, content_disposition(F.col("file_name"))).alias("content_disposition"),
    )


def progress_view(
    events: DataFrame, job_id: str = "job_id", submitted: DataFrame | None = None
) -> DataFrame:
    """(job_id, display, percent) from the last status each job reported.

    With `submitted` (job_id), the jobs in it that have no event yet are converting, too.
    """
    if submitted is not None:
        events = events.select(job_id, "seq", "name", "data").unionByName(
            submitted.select(job_id), allowMissingColumns=True
        )
    reported = (F.col("name") == STATUS_EVENT) & F.col("data").isin(CONVERTING, SUCCESSFUL, FAILED)
    last = F.max_by("data", F.when(reported, F.col("seq"))).alias("_status")
    # Display texts.
    display = (
        F.when(F.col("_status") == SUCCESSFUL, "Conversion complete!")
        .when(F.col("_status") == FAILED, "Failed!")
        .otherwise("Converting...")
    )
    percent = F.when(F.col("_status").isin(SUCCESSFUL, FAILED), 100).otherwise(50)
    return (
        events.groupBy(job_id)
        .agg(last)
        .select(job_id, display.alias("display"), percent.alias("percent"))
    )
