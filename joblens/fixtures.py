"""Derived input views. The SQL runs unchanged in Spark and in the SQL check."""

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["events", "documents", "conversations", "pages", "region"]

# name -> (views it reads, SQL). Views come after the views they read.
VIEWS: dict[str, tuple[list[str], str]] = {
    "submissions_fx": (
        [],
        """
        select submission_id, ts, user_id, video,
               case submission_id % 16 when 15 then null when 14 then '' else video end as request_video
        from (select event_id as submission_id, ts, user_id,
                case event_id % 8
                  when 0 then concat('https://www.youtube.com/watch?v=', k)
                  when 1 then concat('www.youtube.com/watch?v=', k)
                  when 2 then concat('https://youtu.be/', k)
                  when 3 then concat('https://www.youtube.com/embed/', k)
                  when 4 then k
                  when 5 then concat('https://m.youtube.com/watch?v=', k)
                  when 6 then 'https://www.youtube.com/watch'
                  else concat('https://WWW.YouTube.com/Watch?t=1&v=', k) end as video
              from (select *, concat('vid', lpad(cast(user_id as string), 8, '0')) as k
                    from {events}) e) s
        """,
    ),
    "job_changes_fx": (
        [],
        """
        select event_id as version, ts, user_id,
               concat('youtube-vid', lpad(cast(user_id as string), 8, '0')) as store_name,
               concat('video', cast(user_id as string), '-', cast(event_id % 3 as string)) as job_id,
               case event_type when 'click' then 'SUBMIT' when 'view' then 'CONVERTING'
                    when 'purchase' then 'SUCCESSFUL' when 'error' then 'FAILED' else 'DELETE' end as kind
        from {events}
        """,
    ),
    "statuses_fx": (
        ["job_changes_fx"],
        """
        select job_id, version, ts,
               case kind when 'SUBMIT' then 'CREATED' else kind end as status
        from job_changes_fx where kind <> 'DELETE'
        """,
    ),
    "jobs_fx": (
        ["job_changes_fx"],
        """
        select id, store_name, status,
               case when status = 'FAILED'
                    then concat('Bad Exit Code ', cast(version % 5 + 1 as string)) end as failure_reason,
               case when status = 'SUCCESSFUL' then
                    case version % 2 when 0 then concat('Song ', cast(version as string), '.mp3')
                         else concat('Café ', cast(version as string), '.mp3') end end as file_name,
               version
        from (select job_id as id, store_name,
                     case kind when 'SUBMIT' then 'CREATED' else kind end as status, version,
                     row_number() over (partition by job_id order by ts desc, version desc) as rn
              from job_changes_fx where kind <> 'DELETE') j
        where rn = 1
        """,
    ),
    "files_fx": (
        ["job_changes_fx"],
        """
        select store_name, 1704067200000 + max(version) * 1000 as end_ms, max(version) * 7 + 1 as length
        from job_changes_fx where kind = 'SUCCESSFUL' and user_id % 10 <> 0 group by store_name
        """,
    ),
    "results_fx": (
        [],
        """
        select concat('youtube-', k) as store_name, k as video_id,
               case when event_id % 13 <> 5 then event_id % 3 end as exit_code,
               case when event_id % 9 <> 3
                    then concat('Song ', cast(event_id as string), '-', k, '.mp3') end as result_name,
               case when event_id % 11 = 0 then 'Error: io' end as exception_text,
               event_id as version
        from (select *, concat('vid', lpad(cast(user_id as string), 8, '0')) as k from {events}) e
        """,
    ),
    "logs_fx": (
        [],
        "select doc_id as job_id, replace(text, '. ', concat('.', chr(13))) as log from {documents}",
    ),
    "event_log_fx": (
        [],
        """
        select conv_id as job_id, turn as seq,
               case role when 'system' then 'status' else 'outputLine' end as name, text as data
        from {conversations}
        """,
    ),
    "live_log_fx": (
        ["event_log_fx"],
        """
        select job_id, seq, name, data,
               timestamp '2024-01-01 00:00:00' + seq * interval '1' second as ts
        from event_log_fx
        """,
    ),
    "subscriptions_fx": (
        [],
        """
        select conv_id * 10 as subscriber,
               case when conv_id % 7 = 6 then conv_id + 1000000 else conv_id end as job_id,
               case conv_id % 5 when 0 then null when 1 then '0' when 2 then 'abc' when 3 then '2'
                    else '-5' end as last_event_id
        from (select distinct conv_id from {conversations}) c
        """,
    ),
    "lookups_fx": (
        [],
        """
        select distinct concat('video', cast(user_id as string), '-', cast(event_id % 4 as string)) as id
        from {events}
        """,
    ),
    "ranges_fx": (
        [],
        """
        select r_regionkey as range_id,
               case when r_regionkey > 0
                    then 1704067200000 + cast(r_regionkey as bigint) * 500000 end as from_ms,
               case when r_regionkey < 4
                    then 1704067200000 + cast(r_regionkey as bigint) * 500000 + 9000000 end as to_ms
        from {region}
        """,
    ),
    "range_args_fx": (
        [],
        """
        select event_id as request_id,
               case event_id % 5 when 0 then null when 1 then 'x' when 2 then '-7'
                    else cast(event_id * 1000 as string) end as from_text,
               case event_id % 7 when 0 then null when 1 then '9.5'
                    else cast(user_id * 90000 as string) end as to_text
        from {events}
        """,
    ),
}


def _needed(names: list[str]) -> list[str]:
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted.update(VIEWS[name][0])
    return [name for name in VIEWS if name in wanted]


def with_views(names: list[str], query: str, **tables: str) -> str:
    """`query` over the named views. `tables` tells how to write a base table."""
    views = [f"{name} as ({VIEWS[name][1].strip()})" for name in _needed(names)]
    text = f"with {', '.join(views)} {query}" if views else query
    written = {name: name for name in BASE_TABLES} | tables
    for name, spelled in written.items():
        text = text.replace("{" + name + "}", spelled)
    return text


def view(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """A derived view over the parquet tables in `sf_dir`, or over the given base tables."""
    spelled = {base: "{" + base + "}" for base in BASE_TABLES}
    text = with_views([name], f"select * from {name}", **spelled)
    used = {base for base in BASE_TABLES if "{" + base + "}" in text}
    inputs = {
        base: tables.get(base, spark.read.parquet(f"{sf_dir}/{base}.parquet")) for base in used
    }
    return spark.sql(text, **inputs)
