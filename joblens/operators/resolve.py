"""From submitted text to a validated video id and its store name."""

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblens.functions import names, urls
from joblens.functions.columns import once
from joblens.functions.urls import Url
from joblens.plans.ordered import numbered

# Provider names and the hosts and paths that carry an id.
YOUTUBE = "youtube"
WATCH_HOST = "www.youtube.com"
SHORT_HOST = "youtu.be"
WATCH_PATH = "watch"
EMBED_PATH = "embed"
WATCH_KEY = "v"
UNKNOWN = "unknown"


def split_errors(df: DataFrame, error: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """Rows without an error (the column dropped) and rows with one."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def check_submissions(
    df: DataFrame, video: str = "video", body: str | None = None, trim_blank: bool = False
) -> DataFrame:
    """Add `error_code`: no body, or no video in it. `trim_blank` also rejects blank text."""
    text = F.trim(video) if trim_blank else F.col(video)
    error = F.when(text.isNull() | (text == ""), "video.not.provided")
    if body is not None:
        error = F.when(F.col(body).isNull(), "body.not.provided").otherwise(error)
    return df.withColumn("error_code", error)


def validate_submissions(
    df: DataFrame, video: str = "video", body: str | None = None, trim_blank: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)."""
    return split_errors(check_submissions(df, video, body, trim_blank))


def normalize_urls(df: DataFrame, video: str = "video") -> DataFrame:
    """Add `url`, null when the text is no URL."""
    url = urls.as_url(F.col(video))
    return df.withColumn(
        "url", F.when(F.try_parse_url(url, F.lit("PATH")).isNotNull(), url)
    )


def explode_path_parts(df: DataFrame, row_id: str, url: str = "url") -> DataFrame:
    """(row_id, pos, part) for every non-empty path part."""
    parsed, parts = urls.with_url(df.select(row_id, url), url)
    return parsed.select(row_id, F.posexplode(parts.path_parts).alias("pos", "part"))


def check_query_params(df: DataFrame, row_id: str, url: str = "url") -> DataFrame:
    """(row_id, key, value, error_code): the pairs of each query, or one row with its error."""
    parsed, parts = urls.with_url(df.select(row_id, url), url)
    rows = parsed.where(parts.is_valid).select(
        row_id,
        parts.query.alias("_text"),
        urls.query_error(parts.query).alias("error_code"),
    )
    entries = F.when(F.col("error_code").isNull(), F.split("_text", "&"))
    exploded = rows.select(row_id, "error_code", F.explode_outer(entries).alias("_entry"))
    pair = F.split("_entry", "=", 2)
    return exploded.select(row_id, pair[0].alias("key"), pair[1].alias("value"), "error_code")


def explode_query_params(
    df: DataFrame, row_id: str, url: str = "url"
) -> tuple[DataFrame, DataFrame]:
    """((row_id, key, value), (row_id, error_code)): a query with any bad entry gives no pairs."""
    pairs, bad = split_errors(check_query_params(df, row_id, url))
    return pairs, bad.select(row_id, "error_code")


class Match(NamedTuple):
    """What a rule says about a row: an id, an error code, or (both null) no match."""

    provider: str
    id: Column
    error_code: Column


Rule = Callable[[Url], Match]


def youtube_rule(url: Url) -> Match:
    """Watch, embed and short links."""
    first = F.try_element_at(url.path_parts, F.lit(1))
    on_site = url.host == WATCH_HOST
    is_watch = on_site & (F.lower(first) == WATCH_PATH)
    is_embed = on_site & (F.lower(first) == EMBED_PATH)
    return Match(
        provider=YOUTUBE,
        id=F.when(is_watch, urls.query_value(url.query, WATCH_KEY))
        .when(is_embed, F.try_element_at(url.path_parts, F.lit(2)))
        .when(url.host == SHORT_HOST, first),
        error_code=F.when(url.is_valid & url.host.isNull(), "host.missing")
        .when(url.host.isin(WATCH_HOST, SHORT_HOST) & first.isNull(), "path.missing")
        .when(is_watch, urls.query_error(url.query)),
    )


def vectorised_rule(provider: str, find: Callable[..., pa.Array]) -> Rule:
    """A rule for what columns cannot say: `find` takes Arrow arrays of addresses, hosts and queries,
    and gives an array of ids, null for no match. Rules of columns beside it stay generated code."""
    find_ids = F.arrow_udf(find, "string")

    def rule(url: Url) -> Match:
        found = find_ids(url.video, url.host, url.query)
        return Match(provider=provider, id=found, error_code=F.lit(None).cast("string"))

    return rule


RULES: tuple[Rule, ...] = (youtube_rule,)


def match_videos(df: DataFrame, rules: Sequence[Rule] = RULES, video: str = "video") -> DataFrame:
    """Add `provider`, `id`, `error_code` of the first rule with a result; all null for no match."""
    parsed, url = urls.with_url(df, video)
    matches = [rule(url) for rule in rules]
    columns = {f"_id{n}": match.id for n, match in enumerate(matches)}
    columns |= {f"_error{n}": match.error_code for n, match in enumerate(matches)}
    rows = urls.without_url(once(parsed, **columns))
    provider = video_id = error_code = None
    for n, match in reversed(list(enumerate(matches))):
        error, found = F.col(f"_error{n}"), F.col(f"_id{n}")
        is_broken, is_found = error.isNotNull(), found.isNotNull()
        nothing = F.lit(None).cast("string")
        error_code = F.when(is_broken, error).when(is_found, nothing).otherwise(error_code)
        provider = F.when(is_broken, nothing).when(is_found, match.provider).otherwise(provider)
        video_id = F.when(is_broken, nothing).when(is_found, found).otherwise(video_id)
    return rows.withColumns(
        {"provider": provider, "id": video_id, "error_code": error_code}
    ).drop(*columns)


def resolve_video_ids(
    df: DataFrame, rules: Sequence[Rule] = RULES, video: str = "video"
) -> tuple[DataFrame, DataFrame]:
    """(resolved, quarantine). Resolved rows without a match have null `provider` and `id`."""
    return split_errors(match_videos(df, rules, video))


def or_unknown(df: DataFrame, video: str = "video") -> DataFrame:
    """Fall back to the raw text as id where no rule matched."""
    no_match = F.col("provider").isNull() & F.col("error_code").isNull()
    return df.withColumns(
        {
            "provider": F.when(no_match, F.lit(UNKNOWN)).otherwise(F.col("provider")),
            "id": F.when(no_match, F.col(video)).otherwise(F.col("id")),
        }
    )


def dispatch_providers(
    df: DataFrame, rules: Sequence[Rule] = RULES, video: str = "video"
) -> tuple[DataFrame, DataFrame]:
    """(resolved, quarantine); every resolved row has a provider and an id."""
    return split_errors(or_unknown(match_videos(df, rules, video), video))


def with_store_name(df: DataFrame) -> DataFrame:
    return df.withColumn("store_name", names.store_name(F.col("provider"), F.col("id")))


def assign_job_ids(
    df: DataFrame,
    prefix: str = "video",
    seed: str = "",
    ts: str = "ts",
    row_id: str = "submission_id",
    **sizes,
) -> DataFrame:
    """Add `job_id`: prefix, time in nanoseconds, counter among equal times, 64 hash bits.

    The hash takes the place of a random number, so a rerun gives the same ids.
    """
    counted = numbered(df, [ts], [row_id], "_counter", **sizes)
    nanos = F.unix_micros(F.col(ts).cast("timestamp")) * 1000
    tail = F.substring(F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string"))), 1, 16)
    return counted.withColumn(
        "job_id", F.concat(F.lit(prefix), names.hex16(nanos), names.hex16(F.col("_counter")), tail)
    ).drop("_counter")


def build_completed(results: DataFrame) -> DataFrame:
    """(store_name, file_name, version) of the last successful result of each store name."""
    file_name = names.strip_id(F.col("result_name"), F.col("video_id"))
    return (
        results.where("status = 'SUCCESSFUL'")
        .select("store_name", file_name.alias("file_name"), "version")
        .groupBy("store_name")
        .agg(F.max_by("file_name", "version").alias("file_name"), F.max("version").alias("version"))
    )
