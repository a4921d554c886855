"""From process logs to numbered events and back."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblens.functions.names import utf8
from joblens.plans.ordered import Chunks, numbered, with_previous
from joblens.schemas import CREATED, LINE_EVENT, RETURN_EVENT, STATUS_EVENT

# Output beyond this takes another row.
SEGMENT_BYTES = 8 << 20


def log_tokens(log: Column) -> Column:
    """A log as an array: one element per line, and an element '\\r' after a line it ended."""
    tokens = F.split(F.replace(log, F.lit("\r"), F.lit("\n\r\n")), "\n")
    is_open = (F.element_at(tokens, -1) != "").cast("int")
    return F.slice(tokens, 1, F.size(tokens) - 1 + is_open)


def split_log_events(logs: DataFrame, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """(job_id, seq, name, data) for each whole log.

    A line feed ends a line; a carriage return ends a line and is an event of its own. What follows
    the last terminator is a line only if there is any of it.
    """
    text = utf8(F.col(log)) if dict(logs.dtypes)[log] == "binary" else F.col(log)
    tokens = logs.select(job_id, F.posexplode(log_tokens(text)).alias("seq", "data"))
    is_return = F.col("data") == "\r"
    return tokens.select(
        job_id,
        F.col("seq").cast("bigint").alias("seq"),
        F.when(is_return, RETURN_EVENT).otherwise(LINE_EVENT).alias("name"),
        F.when(is_return, "").otherwise(F.col("data")).alias("data"),
    )


def number_events(
    events: DataFrame, order: list[str], job_id: str = "job_id", **sizes
) -> DataFrame:
    """Add `seq`: the number of earlier events of the job."""
    return numbered(events, [job_id], order, "seq", **sizes)


def status_transitions(
    changes: DataFrame,
    order: list[str],
    job_id: str = "job_id",
    status: str = "status",
    **sizes,
) -> DataFrame:
    """Rows whose status differs from the one before; a job starts as CREATED."""
    chunks = Chunks(changes, [job_id], order, **sizes)
    rows = with_previous(chunks, chunks.rows, status, "_previous")
    changed = rows.where(F.col(status) != F.coalesce("_previous", F.lit(CREATED)))
    return chunks.done(changed).drop("_previous")


def status_events(transitions: DataFrame, status: str = "status") -> DataFrame:
    """Transitions in event form."""
    return transitions.withColumn("name", F.lit(STATUS_EVENT)).withColumnRenamed(status, "data")


def output_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("name").isin(LINE_EVENT, RETURN_EVENT))


def assemble_raw_output(
    events: DataFrame, job_id: str = "job_id", segment_bytes: int = SEGMENT_BYTES, **sizes
) -> DataFrame:
    """(job_id, part, raw_output): the captured text, every line ended by its terminator.

    A job of more than `segment_bytes` takes several parts; joined in order they are the text. A part
    is smaller than that and one line; a line that is longer leaves part numbers out.
    """
    narrow = output_events(events).select(job_id, "seq", "name", "data")
    is_line = F.col("name") == LINE_EVENT
    size = F.when(is_line, F.octet_length("data") + 1).otherwise(0).alias("_size")
    chunks = Chunks(narrow.select("*", size), [job_id], ["seq"], **sizes)
    rows = chunks.rows.withColumn("_after", F.lead("name").over(chunks.ordered()))
    before = chunks.ordered().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_so_far", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rows = chunks.with_neighbours(
        rows,
        {"_edge": F.min_by("name", chunks.at()), "_bytes": F.sum("_size")},
        lambda over: {
            "_next": F.lead("_edge").over(over),
            "_earlier": F.sum("_bytes").over(over.rowsBetween(Window.unboundedPreceding, -1)),
        },
    )
    is_return = F.coalesce("_after", "_next") == RETURN_EVENT
    place = F.col("_so_far") + F.coalesce(F.col("_earlier"), F.lit(0))
    lines = rows.where(is_line).select(
        job_id,
        F.call_function("div", place, F.lit(segment_bytes)).alias("part"),
        F.struct("seq", F.concat("data", F.when(is_return, "\r").otherwise("\n")).alias("text")).alias("_line"),
    )
    collected = lines.groupBy(job_id, "part").agg(
        F.sort_array(F.collect_list("_line")).alias("_lines")
    )
    return collected.select(job_id, "part", F.array_join("_lines.text", "").alias("raw_output"))


def fold_terminal(events: DataFrame, job_id: str = "job_id", **sizes) -> DataFrame:
    """(job_id, seq, data) of the lines a terminal would still show.

    A line is overwritten when a carriage return follows it and another line comes later.
    """
    chunks = Chunks(
        output_events(events).select(job_id, "seq", "name", "data"), [job_id], ["seq"], **sizes
    )
    line_seq = F.when(F.col("name") == LINE_EVENT, F.col("seq"))
    rows = chunks.rows.withColumns(
        {
            "_after": F.lead("name").over(chunks.ordered()),
            "_last_line": F.max(line_seq).over(chunks.whole()),
        }
    )
    rows = chunks.with_neighbours(
        rows,
        {"_edge": F.min_by("name", chunks.at()), "_line": F.max(line_seq)},
        lambda over: {
            "_next_edge": F.lead("_edge").over(over),
            "_line_of_job": F.max("_line").over(
                over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        },
    )
    rows = rows.withColumns(
        {
            "_next": F.coalesce("_after", "_next_edge"),
            "_last_line": F.coalesce("_line_of_job", "_last_line"),
        }
    )
    overwritten = (F.col("_next") == RETURN_EVENT) & (F.col("_last_line") > F.col("seq"))
    shown = rows.where((F.col("name") == LINE_EVENT) & ~F.coalesce(overwritten, F.lit(False)))
    return shown.select(job_id, "seq", "data")
