"""The flagship query: submissions resolved, joined to the history of finished jobs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblens.operators import lookups, resolve, state
from joblens.queries import HISTORY_FROM_MS, HISTORY_TO_MS, named_submissions, query, view


@query
def recent_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, video) of the jobs that ended in a time range, newest first.

    `video` is the address that last asked for the job's store name.
    """
    submitted = named_submissions(spark, sf_dir).where(F.col("provider") != resolve.UNKNOWN)
    asked = state.latest_by(
        submitted.select("store_name", "video", "ts", "submission_id"),
        "store_name",
        ["ts", "submission_id"],
    )
    finished = view(spark, sf_dir, "jobs_fx").where(
        (F.col("status") == "SUCCESSFUL") & F.col("file_name").isNotNull()
    )
    ended = lookups.with_end_time(finished, view(spark, sf_dir, "files_fx")).where(
        (F.col("end_ms") >= HISTORY_FROM_MS) & (F.col("end_ms") < HISTORY_TO_MS)
    )
    return (
        ended.join(asked, "store_name", "left")
        .orderBy(F.desc("end_ms"), "id")
        .select("id", F.col("file_name").alias("name"), "video")
    )
