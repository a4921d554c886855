"""URL parts as columns."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblens.functions.columns import once

# An entry runs up to the next '&'; its key runs up to the first '='.
ENTRY_WITHOUT_VALUE = r"(?:^|&)[^=&]*(?:&|\z)"
ENTRY_KEY = r"(?:^|&)([^=&]*)=[^&]*"


class Url(NamedTuple):
    """What a provider rule may look at."""

    video: Column
    host: Column
    path_parts: Column
    query: Column
    is_valid: Column


def as_url(video: Column) -> Column:
    """Text that does not start with a protocol is taken as an https address."""
    return F.when(video.rlike(r"^[a-zA-Z]+://"), video).otherwise(
        F.concat(F.lit("https://"), video)
    )


def percent_decode(part: Column) -> Column:
    """Decode %XX only. The form decoder would also turn '+' into a space, so '+' is kept safe."""
    return F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def path_parts(path: Column) -> Column:
    """Non-empty parts of a decoded path."""
    return F.array_remove(F.split(path, "/"), "")


def query_value(query: Column, key: str) -> Column:
    """Value of `key` in a decoded query, null when absent."""
    entry = rf"(?:^|&){key}=([^&]*)"
    return F.when(query.rlike(entry), F.regexp_extract(query, entry, 1))


def query_error(query: Column) -> Column:
    """Error code of a decoded query, null when every entry has a value and its own key."""
    keys = F.regexp_extract_all(query, F.lit(ENTRY_KEY), 1)
    return (
        F.when(query.isNull(), "query.missing")
        .when(query.rlike(ENTRY_WITHOUT_VALUE), "query.malformed")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "query.duplicate")
    )


def with_url(df: DataFrame, video: str = "video") -> tuple[DataFrame, Url]:
    """Parse `video` once per row into helper columns; drop them with `without_url`.

    Path and query are decoded before they are split, so an encoded slash splits too.
    """
    url = as_url(F.col(video))
    parsed = once(
        df,
        _host=F.lower(F.try_parse_url(url, F.lit("HOST"))),
        _path=percent_decode(F.try_parse_url(url, F.lit("PATH"))),
        _query=percent_decode(F.try_parse_url(url, F.lit("QUERY"))),
    )
    # An address that does not parse has no part at all; one that parses always has a path.
    return parsed, Url(
        video=F.col(video),
        host=F.col("_host"),
        path_parts=path_parts(F.col("_path")),
        query=F.col("_query"),
        is_valid=F.col("_path").isNotNull(),
    )


def without_url(df: DataFrame) -> DataFrame:
    return df.drop("_host", "_path", "_query")
