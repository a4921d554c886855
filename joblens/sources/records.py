"""Job records as JSON, and their events as nested arrays."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.functions.columns import once
from joblens.operators.resolve import split_errors
from joblens.plans.ordered import with_segment
from joblens.schemas import RECORD_EVENTS, RECORD_FIELDS, STATUSES
from joblens.sources.snapshots import exists

# Events beyond this take another row. An event counts its texts and a little for its id.
SEGMENT_BYTES = 8 << 20
EVENT_BYTES = 16

KEYED_ENTRIES = "map<string,variant>"


def last_of_keys(rows: DataFrame, entries: str) -> DataFrame:
    """`entries` (a map read from JSON, in which a key may repeat) as an array, the last one of each key.

    Sorted by key and place, an entry is the last of its key if the next one has another key. The
    arrays are columns of their own, so that looking something up in them does not make them again.
    """
    rows = once(rows.withColumnRenamed(entries, "_map"), _all=F.map_entries("_map")).drop("_map")
    places = F.transform("_all", lambda e, at: F.struct(e["key"].alias("key"), (at + 1).alias("at")))
    rows = once(rows, _places=F.array_sort(places))

    def is_last(place: Column, at: Column) -> Column:
        following = F.try_element_at("_places", at + 2)
        return F.coalesce(following["key"] != place["key"], F.lit(True))

    last = F.transform(F.filter("_places", is_last), lambda place: F.element_at("_all", place["at"]))
    return rows.withColumn(entries, last).drop("_all", "_places")


def _is_nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")


def read_record_store(
    spark: SparkSession, paths: str | Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of keyed JSON snapshots, one JSON object per file.

    A missing path or a root that is no object gives no rows; a file that is not JSON is an error.
    An entry that does not decode is quarantined and the others survive.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    found = [path for path in wanted if exists(spark, path)]
    if found:
        files = spark.read.text(found, wholetext=True).withColumn(
            "file", F.col("_metadata.file_path")
        )
    else:
        files = spark.createDataFrame([], "value string, file string")
    return split_errors(decode_entries(files))


def decode_entries(files: DataFrame) -> DataFrame:
    """(file, key, entry fields, error_code) of every entry in (file, value) rows."""
    entries = F.from_json("value", KEYED_ENTRIES)
    is_bad_file = F.col("_entries").isNull() & F.try_parse_json("value").isNull()
    message = F.concat(F.lit("malformed snapshot file "), F.col("file"))
    opened = files.withColumn("_entries", entries).withColumn(
        "_entries",
        F.when(is_bad_file, F.raise_error(message).cast(KEYED_ENTRIES)).otherwise(
            F.col("_entries")
        ),
    )
    listed = last_of_keys(opened, "_entries")
    rows = listed.select("file", F.explode("_entries").alias("_entry")).select(
        "file", F.col("_entry.key").alias("key"), F.col("_entry.value").alias("_value")
    )
    is_object = F.schema_of_variant("_value").startswith("OBJECT<")
    rows = rows.withColumn(
        "_fields", F.when(is_object, F.try_variant_get("_value", "$", KEYED_ENTRIES))
    )
    values = {name: F.try_element_at("_fields", F.lit(name)) for name in RECORD_FIELDS}
    nested = F.lit(False)
    for value in values.values():
        nested = nested | F.coalesce(_is_nested(value), F.lit(False))
    events = F.try_element_at("_fields", F.lit("events"))
    columns = {
        column: F.try_variant_get(values[name], "$", "string")
        for name, column in RECORD_FIELDS.items()
    }
    rows = rows.withColumns(columns).withColumn(
        "events", F.try_variant_get(events, "$", RECORD_EVENTS)
    )
    known = F.array(*[F.lit(name) for name in [*RECORD_FIELDS, "events"]])
    bad_events = (
        events.isNotNull()
        & (F.schema_of_variant(events) != "VOID")
        & F.col("events").isNull()
    )
    error = (
        F.when(F.col("_fields").isNull(), "entry.not.object")
        .when(F.size(F.array_except(F.map_keys("_fields"), known)) > 0, "field.unknown")
        .when(nested | bad_events, "field.malformed")
        .when(F.col("id").isNull(), "id.missing")
        .when(F.col("video").isNull(), "video.missing")
        .when(~F.col("status").isin(STATUSES), "status.unknown")
    )
    return rows.withColumn("error_code", error).drop("_value", "_fields")


def encode_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row with every column, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def decode_records(
    df: DataFrame, schema: T.StructType, name: str = "record"
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine with the offending text)."""
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = df.select(name, F.from_json(name, full, options).alias("_row"))
    is_bad = F.col("_row").isNull() | F.col(f"_row.{corrupt}").isNotNull()
    rows = parsed.where(~is_bad).select(*[f"_row.{field.name}" for field in schema.fields])
    bad = parsed.where(is_bad).select(
        F.col(name), F.lit("record.malformed").alias("error_code")
    )
    return rows, bad


def nest_events(
    events: DataFrame,
    job_id: str = "job_id",
    segment_bytes: int = SEGMENT_BYTES,
    position: str = "seq",
    **sizes,
) -> DataFrame:
    """(job_id, segment, events): arrays of (seq, name, data) in the order of `position`.

    A job of more than `segment_bytes` takes several segments, each smaller than that and one event;
    an event that is larger leaves segment numbers out. `position` is an event's place in its job;
    where events may lack an id, it is a column of its own (`number_events` makes one) and seq stays
    null. An event without a position has no place, which is an error.
    """
    missing = F.raise_error(F.lit(f"an event has no {position}")).cast("bigint")
    place = F.coalesce(F.col(position).cast("bigint"), missing)
    placed = events.select(job_id, place.alias("_at"), "seq", "name", "data")
    size = EVENT_BYTES + F.coalesce(F.octet_length("name"), F.lit(0)) + F.coalesce(F.octet_length("data"), F.lit(0))
    cut = with_segment(placed, [job_id], ["_at"], size, segment_bytes, "segment", **sizes)
    event = F.struct(F.col("_at"), F.struct("seq", "name", "data").alias("_of"))
    ordered = F.sort_array(F.collect_list(event))
    return cut.groupBy(job_id, "segment").agg(
        F.transform(ordered, lambda e: e["_of"]).alias("events")
    )


def unnest_events(jobs: DataFrame, job_id: str = "job_id") -> DataFrame:
    """(job_id, seq, name, data) of nested events."""
    return jobs.select(job_id, F.explode("events").alias("_event")).select(job_id, "_event.*")
