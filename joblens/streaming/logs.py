"""Streaming log splitting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joblens.functions.names import utf8
from joblens.plans.ordered import Chunks, running_sums
from joblens.schemas import LINE_EVENT, RETURN_EVENT
from joblens.streaming.batches import FOLD_EVERY, TURN, KeyedState, put, run_batches

# In this character set every byte is one character, so pieces can be cut and joined as text.
BYTES = "ISO-8859-1"


def as_text(letters: Column) -> Column:
    return utf8(F.encode(letters, BYTES))


def log_events_schema(stream: DataFrame) -> str:
    return f"job_id {dict(stream.dtypes)['job_id']}, seq bigint, name string, data string"


def located_pieces(pieces: DataFrame, **sizes) -> DataFrame:
    """Adds to pieces (job_id, TURN, part, piece, sent): `tokens`, the number of the first one's event
    (`first`), and how many pieces of the log before have a terminator (`line`).

    A piece's tokens but the last are its events, if what waits before it is put in front of the
    first one. The effect of a piece on later ones is two sums and its last token, so neither a
    window nor a task needs a whole log.
    """
    letters = F.replace(F.decode("piece", BYTES), F.lit("\r"), F.lit("\n\r\n"))
    rows = pieces.withColumn("tokens", F.split(letters, "\n"))
    rows = rows.withColumns(
        {
            "events": F.size("tokens") - 1 + F.coalesce("sent", F.lit(0)),
            "breaks": (F.size("tokens") > 1).cast("int"),
        }
    )
    chunks = Chunks(rows, ["job_id"], [TURN, "part"], **sizes)
    return chunks.done(running_sums(chunks, chunks.rows, {"first": "events", "line": "breaks"}))


def inner_events(located: DataFrame) -> DataFrame:
    """Events that lie within one piece: all tokens but its first and last."""
    inner = F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0)))
    rows = located.select("job_id", "first", F.posexplode(inner).alias("at", "letters"))
    is_return = F.col("letters") == "\r"
    return rows.select(
        "job_id",
        (F.col("first") + 1 + F.col("at")).alias("seq"),
        F.when(is_return, RETURN_EVENT).otherwise(LINE_EVENT).alias("name"),
        F.when(is_return, "").otherwise(as_text(F.col("letters"))).alias("data"),
    )


def joined_lines(located: DataFrame) -> DataFrame:
    """(job_id, line, seq, letters): lines put together from the ends of pieces; seq is null for the
    one that waits for its terminator."""
    broken = F.col("breaks") == 1
    start = F.struct(
        F.col("line"),
        F.lit(1).alias("side"),
        F.element_at("tokens", 1).alias("letters"),
        F.when(broken, F.col("first")).alias("seq"),
    )
    end = F.struct(
        (F.col("line") + 1).alias("line"),
        F.lit(0).alias("side"),
        F.element_at("tokens", -1).alias("letters"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    sides = F.when(broken, F.array(start, end)).otherwise(F.array(start))
    parts = located.select("job_id", TURN, "part", F.inline(sides))
    inside = F.sort_array(F.collect_list(F.struct(TURN, "part", "side", "letters")))
    return parts.groupBy("job_id", "line").agg(
        F.max("seq").alias("seq"),
        F.array_join(F.transform(inside, lambda p: p["letters"]), "").alias("letters"),
    )


def stream_split_logs(
    stream: DataFrame, base: str, fold_every: int = FOLD_EVERY, trigger: dict | None = None, **sizes
) -> StreamingQuery:
    """Start a query that puts (job_id, seq, name, data) out, from pieces of logs cut anywhere.

    Takes (job_id, part, piece binary, is_last). A log carries what follows its last terminator and
    how many events it has sent. The last piece flushes that, and the log is forgotten; pieces that
    come in later batches are a new log. Bytes become text only per complete line.
    """
    spark, types = stream.sparkSession, dict(stream.dtypes)
    columns = f"job_id {types['job_id']}, piece binary, sent bigint"
    state = KeyedState(spark, base, "job_id", columns, fold_every)

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(F.lit(1).alias(TURN), "job_id", "part", "piece", "is_last")
        carried = state.carried(new, number).withColumn(TURN, F.lit(0))
        pieces = new.unionByName(carried, allowMissingColumns=True)
        located = located_pieces(pieces, **sizes).persist()
        lines = joined_lines(located)
        totals = located.groupBy("job_id").agg(
            F.sum("events").alias("sent"), F.coalesce(F.max("is_last"), F.lit(False)).alias("gone")
        )
        waiting = lines.where("seq is null").join(totals, "job_id").persist()
        flushed = waiting.where("gone and letters <> ''").withColumn("seq", F.col("sent"))
        whole = lines.where("seq is not null").unionByName(flushed.select(lines.columns))
        whole = whole.select(
            "job_id", "seq", F.lit(LINE_EVENT).alias("name"), as_text(F.col("letters")).alias("data")
        )
        put(inner_events(located).unionByName(whole), base, "out", number)
        kept = waiting.select("job_id", F.encode("letters", BYTES).alias("piece"), "sent", "gone")
        state.write(kept, number)
        waiting.unpersist()
        located.unpersist()

    return run_batches(stream, base, step, **(trigger or {}))
