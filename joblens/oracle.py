"""The same queries as plain SQL over the same tables, to check results against."""

from joblens.fixtures import with_views
from joblens.queries import (
    HISTORY_FROM_MS,
    HISTORY_TO_MS,
    MOBILE_HOST,
    NESTED_BYTES,
    PART_BYTES,
    SUBSCRIBED_AT,
)

CHECKS: dict[str, tuple[list[str], str]] = {}


def check(name: str, views: list[str], sql: str) -> None:
    CHECKS[name] = (views, sql)


def queries() -> dict[str, str]:
    return {name: with_views(views, sql) for name, (views, sql) in CHECKS.items()}


def url_parts(rows: str, text: str) -> str:
    """Columns u, host, path, query (null when absent) added to `rows`."""
    return f"""
    (select *, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host,
            url_decode(replace(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '+', '%2B')) as path,
            case when regexp_matches(u, '^[^?#]*[?]') then
                 url_decode(replace(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '+', '%2B')) end as query
     from (select *, case when regexp_matches({text}, '^[a-zA-Z]+://') then {text}
                          else 'https://' || {text} end as u from {rows}) p)
    """


MATCHED = f"""
    (select *, case when code is null and hit is not null then 'youtube' end as provider,
            case when code is null then hit end as video_id
     from (select *,
             case when host in ('www.youtube.com', 'youtu.be') and len(parts) = 0 then 'path.missing'
                  when host = 'www.youtube.com' and lower(parts[1]) = 'watch' then
                       case when query is null then 'query.missing'
                            when len(list_filter(entries, lambda e: not contains(e, '='))) > 0
                            then 'query.malformed'
                            when len(list_distinct(keys)) < len(keys) then 'query.duplicate' end end as code,
             case when host = 'www.youtube.com' and lower(parts[1]) = 'watch'
                  then case when list_contains(keys, 'v') then
                       (entries[list_position(keys, 'v')])[3:] end
                  when host = 'www.youtube.com' and lower(parts[1]) = 'embed' and len(parts) > 1 then parts[2]
                  when host = 'youtu.be' then parts[1] end as hit
           from (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts,
                        string_split(query, '&') as entries,
                        list_transform(string_split(query, '&'), lambda e: string_split(e, '=')[1]) as keys
                 from {url_parts('submissions_fx', 'video')} a) b) c)
"""

STORE_NAME = """regexp_replace(coalesce(provider, 'unknown') || '-' || coalesce(video_id, video),
                               '[/\\\\?%*:|"<>]', '_', 'g')"""

OUTCOMES = """
    (select *, case when error_code is null then
                    case when reason is null then 'SUCCESSFUL' else 'FAILED' end end as status
     from (select *, case when exit_code is null and exception_text is null then 'exit_code.missing' end as error_code,
                  case when exit_code is null and exception_text is null then null
                       when exception_text is not null then 'Error: ' || exception_text
                          when exit_code <> 0 then 'Bad Exit Code ' || exit_code
                          when result_name is null then 'Error: no result given' end as reason
           from results_fx) o)
"""

COMPLETED = f"""
    (select store_name, replace(result_name, '-' || video_id, '') as file_name, version
     from {OUTCOMES} r where status = 'SUCCESSFUL'
     qualify row_number() over (partition by store_name order by version desc) = 1)
"""

# One row per event: lines are what lies between terminators.
EVENTS = """
    (select job_id, row_number() over (partition by job_id order by i, is_return) - 1 as seq,
            case is_return when 1 then 'carriageReturn' else 'outputLine' end as name,
            case is_return when 1 then '' else line end as data
     from (select job_id, i, line, unnest(case when sep = chr(13) then [0, 1] else [0] end) as is_return
           from (select job_id, unnest(lines) as line, unnest(seps) as sep, unnest(range(len(lines))) as i
                 from (select job_id, string_split_regex(log, '[\\r\\n]') as lines,
                              list_append(regexp_extract_all(log, '[\\r\\n]'), '') as seps
                       from logs_fx) l) t
           where sep <> '' or line <> '') e)
"""

RAW_PARTS = f"""
    (select job_id, cast(coalesce(before, 0) // {PART_BYTES} as bigint) as part,
            string_agg(data || case when after = 'carriageReturn' then chr(13) else chr(10) end, '' order by seq)
              as raw_output
     from (select *, lead(name) over (partition by job_id order by seq) as after,
                  sum(case when name = 'outputLine' then strlen(data) + 1 else 0 end) over
                    (partition by job_id order by seq rows between unbounded preceding and 1 preceding) as before
           from {EVENTS} e) p
     where name = 'outputLine' group by all)
"""

TRANSITIONS = """
    (select job_id, version, ts, status from
       (select *, lag(status, 1, 'CREATED') over (partition by job_id order by ts, version) as was
        from statuses_fx) s where status <> was)
"""


def latest(key: str, rows: str = "job_changes_fx") -> str:
    return f"""(select * from (select *, row_number() over
        (partition by {key} order by ts desc, version desc) as rn from {rows}) l
        where rn = 1 and kind <> 'DELETE')"""


CANONICAL = """
    (select version, store_name,
            first_value(version) over (partition by store_name, episode order by ts, version) as canonical
     from (select *, sum(case when kind <> 'SUBMIT' then 1 else 0 end) over
                  (partition by store_name order by ts, version rows unbounded preceding) as episode
           from job_changes_fx where kind in ('SUBMIT', 'FAILED', 'DELETE')) s
     where kind = 'SUBMIT')
"""

OFFSETS = """
    (select *, case when skip < 0 or skip > 2147483647 then 'skip.negative' end as error_code
     from (select subscriber, job_id,
                  coalesce(case when regexp_full_match(last_event_id, '[+-]?[0-9]+')
                                then cast(try_cast(last_event_id as integer) as bigint) + 1 end, 0) as skip
           from subscriptions_fx) o)
"""

REPLAYED = f"""
    (select s.subscriber, s.job_id, e.seq, e.name, e.data, true as job_found
     from {OFFSETS} s join event_log_fx e on e.job_id = s.job_id and e.seq >= s.skip
     where s.error_code is null
     union all
     select subscriber, job_id, null, null, null, false from {OFFSETS} s
     where error_code is null and job_id not in (select job_id from event_log_fx))
"""

TAILED = f"""
    (select s.subscriber, e.job_id, e.seq, e.name, e.data
     from {OFFSETS} s join live_log_fx e on e.job_id = s.job_id
     where s.error_code is null and (e.seq >= s.skip or e.ts >= timestamp '{SUBSCRIBED_AT}'))
"""

ENDED = """
    (select j.*, coalesce(f.end_ms, 0) as end_ms, f.length
     from jobs_fx j left join files_fx f on f.store_name = j.store_name)
"""

check(
    "validate_submissions",
    ["submissions_fx"],
    """select submission_id, request_video,
              case when coalesce(request_video, '') = '' then 'video.not.provided' end as error_code
       from submissions_fx""",
)
check(
    "normalize_urls",
    ["submissions_fx"],
    f"select submission_id, u as url from {url_parts('submissions_fx', 'video')} p",
)
check(
    "explode_path_parts",
    [],
    f"""select page_id, unnest(parts) as part, cast(unnest(range(len(parts))) as integer) as pos
        from (select page_id, list_filter(string_split(path, '/'), lambda x: x <> '') as parts
              from {url_parts('pages', 'url')} a) b""",
)
check(
    "explode_query_params",
    [],
    f"""with q as (select page_id, query, string_split(query, '&') as entries
                   from {url_parts('pages', 'url')} a),
             k as (select *, list_transform(entries, lambda e: string_split(e, '=')[1]) as keys from q),
             c as (select *, case when query is null then 'query.missing'
                     when len(list_filter(entries, lambda e: not contains(e, '='))) > 0 then 'query.malformed'
                     when len(list_distinct(keys)) < len(keys) then 'query.duplicate' end as error_code
                   from k)
        select page_id, string_split(e, '=')[1] as key, substr(e, strpos(e, '=') + 1) as value,
               null::varchar as error_code
        from (select page_id, unnest(entries) as e from c where error_code is null) x
        union all select page_id, null, null, error_code from c where error_code is not null""",
)
check(
    "resolve_video_ids",
    ["submissions_fx"],
    f"select submission_id, provider, video_id as id, code as error_code from {MATCHED} m",
)
check(
    "dispatch_providers",
    ["submissions_fx"],
    f"""select submission_id, coalesce(provider, 'unknown') as provider, coalesce(video_id, video) as id
        from {MATCHED} m where code is null""",
)
check(
    "with_store_name",
    ["submissions_fx"],
    f"select submission_id, {STORE_NAME} as store_name from {MATCHED} m where code is null",
)
check(
    "assign_job_ids",
    ["submissions_fx"],
    """select submission_id,
              'video' || lpad(lower(to_hex(epoch_us(ts) * 1000)), 16, '0')
              || lpad(lower(to_hex(row_number() over (partition by ts order by submission_id) - 1)), 16, '0')
              || substr(md5('s' || submission_id), 1, 16) as job_id
       from submissions_fx""",
)
check(
    "classify_outcomes",
    ["results_fx"],
    f"select version, status, reason as failure_reason, error_code from {OUTCOMES} r",
)
check("build_completed", ["results_fx"], f"select * from {COMPLETED} c")
check(
    "split_cached",
    ["submissions_fx", "results_fx"],
    f"""select s.submission_id, s.store_name, c.file_name,
               case when c.store_name is not null then 'SUCCESSFUL' end as status
        from (select submission_id, {STORE_NAME} as store_name from {MATCHED} m where code is null) s
        left join {COMPLETED} c on c.store_name = s.store_name""",
)
check("split_log_events", ["logs_fx"], f"select * from {EVENTS} e")
check(
    "fold_terminal",
    ["logs_fx"],
    f"""select job_id, seq, data from
          (select *, lead(name, 1) over w as after, lead(name, 2) over w as later from {EVENTS} e
           window w as (partition by job_id order by seq)) f
        where name = 'outputLine' and not (coalesce(after, '') = 'carriageReturn' and later is not null)""",
)
check(
    "assemble_raw_output",
    ["logs_fx"],
    f"select * from {RAW_PARTS} r",
)
check(
    "raw_output_of",
    ["logs_fx"],
    f"""select j.id, r.part, r.raw_output as value,
               case when r.raw_output is null then 'not_found' end as error_code
        from (select doc_id as id from documents union all select doc_id + 1000000000 from documents) j
        left join {RAW_PARTS} r on r.job_id = j.id""",
)
check(
    "nest_events",
    ["event_log_fx"],
    f"""select job_id, cast(coalesce(before, 0) // {NESTED_BYTES} as bigint) as segment,
               string_agg(concat_ws('|', seq, name, data), chr(10) order by seq) as events
        from (select *, sum(16 + coalesce(strlen(name), 0) + coalesce(strlen(data), 0)) over
                (partition by job_id order by seq rows between unbounded preceding and 1 preceding) as before
              from event_log_fx) e group by all""",
)
check("unnest_events", ["event_log_fx"], "select * from event_log_fx")
check(
    "number_events",
    ["job_changes_fx"],
    """select job_id, version, row_number() over (partition by job_id order by ts, version) - 1 as seq
       from job_changes_fx""",
)
check(
    "status_transitions",
    ["statuses_fx"],
    f"select job_id, version, status from {TRANSITIONS} t",
)
check(
    "latest_by_id",
    ["job_changes_fx"],
    f"select job_id, store_name, kind, version from {latest('job_id')} l",
)
check(
    "latest_by_store",
    ["job_changes_fx"],
    f"select store_name, job_id, kind, version from {latest('store_name')} l",
)
check("assign_canonical", ["job_changes_fx"], f"select * from {CANONICAL} c")
check(
    "stale_results",
    ["job_changes_fx", "files_fx"],
    """select * from files_fx where store_name in
         (select store_name from
            (select store_name, kind,
                    lag(kind) over (partition by store_name order by ts, version) as was
             from (select *, last_value(case when kind <> 'FAILED' then kind end ignore nulls) over
                             (partition by store_name order by ts, version
                              rows unbounded preceding) as owner
                   from job_changes_fx where kind in ('SUBMIT', 'FAILED', 'DELETE')) a
             where not (kind = 'FAILED' and coalesce(owner, 'DELETE') = 'DELETE')) b
          where kind = 'SUBMIT' and was = 'FAILED')""",
)
check(
    "stale_disconnected",
    ["job_changes_fx", "files_fx"],
    f""", kept as (select * from job_changes_fx where version % 4 <> 1),
        entries as (select * from (select *, row_number() over
                      (partition by store_name order by ts desc, version desc) as rn
                    from job_changes_fx where kind <> 'DELETE' and version % 4 = 0) e
                    where rn = 1 and job_id not in (select job_id from {latest('job_id')} i))
        select * from files_fx where store_name in
          (select store_name from
             (select store_name, kind,
                     lag(kind) over (partition by store_name order by ts, version) as was
              from (select *, last_value(case when kind <> 'FAILED' then kind end ignore nulls) over
                              (partition by store_name order by ts, version
                               rows unbounded preceding) as owner
                    from kept where kind in ('SUBMIT', 'FAILED', 'DELETE')) a
              where not (kind = 'FAILED' and coalesce(owner, 'DELETE') = 'DELETE')) b
           where kind = 'SUBMIT' and was = 'FAILED')
         or store_name in (select e.store_name from entries e join kept k on k.store_name = e.store_name
                           where k.kind = 'SUBMIT' and (k.ts, k.version) > (e.ts, e.version))""",
)
check(
    "scan_results",
    [],
    "select s_name as store_name, strlen(s_name || ' ' || s_suppkey) + 1 as length from supplier",
)
check(
    "dispatch_vectorised",
    ["submissions_fx"],
    f"""select submission_id,
               coalesce(provider, case when host = '{MOBILE_HOST}' then 'mobile' end, 'unknown') as provider,
               coalesce(video_id, case when host = '{MOBILE_HOST}' then
                        regexp_extract(query, '(^|&)v=([^&]*)', 2) end, video) as id
        from {MATCHED} m where code is null""",
)
check(
    "audit_disconnects",
    ["job_changes_fx"],
    f"""select store_name, job_id
        from {latest('store_name', "(select * from job_changes_fx where kind <> 'DELETE')")} s
        where job_id not in (select job_id from {latest('job_id')} i)""",
)
check(
    "purge_resubmit",
    ["job_changes_fx"],
    f"""select store_name, job_id, version from {latest('store_name')} l where kind = 'SUCCESSFUL'""",
)
check(
    "active_jobs",
    ["job_changes_fx"],
    f"""select job_id, store_name, version from {latest('job_id')} l where kind = 'CONVERTING'""",
)
check(
    "cascade_delete",
    ["job_changes_fx", "jobs_fx", "files_fx", "results_fx", "lookups_fx"],
    f""", gone as (select id, store_name from jobs_fx where status = 'FAILED')
        select 'by_id' as view, id as key from jobs_fx where status <> 'FAILED'
        union all select 'by_store', store_name from {latest('store_name')} l
                  where store_name not in (select store_name from gone)
        union all select 'completed', store_name from {COMPLETED} c
                  where store_name not in (select store_name from gone)
        union all select 'files', store_name from files_fx
                  where store_name not in (select store_name from gone)
        union all select 'not_found', id from lookups_fx where id not in (select id from jobs_fx)""",
)
check(
    "resume_offsets",
    ["subscriptions_fx"],
    f"select * from {OFFSETS} o",
)
check("replay", ["subscriptions_fx", "event_log_fx"], f"select * from {REPLAYED} r")
check(
    "dedupe_delivery",
    ["subscriptions_fx", "event_log_fx"],
    f"""select subscriber, job_id, seq, name, data from {REPLAYED} r where job_found and name <> 'status'
        union all
        select subscriber, job_id, null, name, data from {REPLAYED} r, (values (1), (2)) copies
        where job_found and name = 'status'""",
)
check("with_end_time", ["jobs_fx", "files_fx"], f"select id, end_ms from {ENDED} e")
check(
    "parse_range",
    ["range_args_fx"],
    """select request_id, f as from_ms, t as to_ms,
              case when f < 0 then 'from.too.small' when t < f then 'to.too.small' end as error_code
       from (select request_id, try_cast(case when regexp_full_match(from_text, '[+-]?[0-9]+')
                                              then from_text end as bigint) as f,
                    try_cast(case when regexp_full_match(to_text, '[+-]?[0-9]+')
                                  then to_text end as bigint) as t
             from range_args_fx) p""",
)
check(
    "history",
    ["jobs_fx", "files_fx"],
    f"""select id, file_name as name from {ENDED} e
        where status = 'SUCCESSFUL' and end_ms >= {HISTORY_FROM_MS} and end_ms < {HISTORY_TO_MS}
        order by end_ms desc, id""",
)
check(
    "history_ranges",
    ["jobs_fx", "files_fx", "ranges_fx"],
    f"""select r.range_id, e.id, e.file_name as name from {ENDED} e join ranges_fx r
          on e.end_ms >= coalesce(r.from_ms, -9223372036854775808)
         and e.end_ms < coalesce(r.to_ms, 9223372036854775807)
        where e.status = 'SUCCESSFUL'""",
)
check(
    "status_of",
    ["lookups_fx", "jobs_fx"],
    """select l.id, j.status, case when j.status = 'FAILED' then j.failure_reason end as reason,
              case when j.id is null then 'not_found'
                   when j.status = 'FAILED' and j.failure_reason is null then 'reason.missing'
              end as error_code
       from lookups_fx l left join jobs_fx j on j.id = l.id""",
)
check(
    "property_of",
    ["lookups_fx", "jobs_fx"],
    """select l.id, j.file_name as value,
              case when j.file_name is null then 'not_found' end as error_code
       from lookups_fx l left join jobs_fx j on j.id = l.id""",
)
check(
    "export_manifest",
    ["lookups_fx", "jobs_fx", "files_fx"],
    f"""select id, case when error_code is null then 200 when error_code = 'not_found' then 404
                        when error_code like 'conversion.%' then 409 else 500 end as code,
               error_code, case when error_code = 'conversion.not.finished' then status end as status,
               case when error_code is null then length end as content_length,
               case when error_code is null then
                    case when strlen(file_name) = length(file_name)
                         then 'attachment; filename="' || file_name || '"'
                         else 'attachment; filename="' || url_encode(file_name)
                              || '"; filename*=utf8''''' || url_encode(file_name) end
               end as content_disposition
        from (select l.id, e.status, e.length, e.file_name,
                     case when e.id is null then 'not_found' when e.status = 'FAILED' then 'conversion.failed'
                          when e.status <> 'SUCCESSFUL' then 'conversion.not.finished'
                          when e.length is null then 'file.missing'
                          when e.file_name is null then 'name.missing' end as error_code
              from lookups_fx l left join {ENDED} e on e.id = l.id) m""",
)
check(
    "progress_view",
    ["statuses_fx"],
    f"""select job_id,
               case status when 'SUCCESSFUL' then 'Conversion complete!' when 'FAILED' then 'Failed!'
                    else 'Converting...' end as display,
               case when status in ('SUCCESSFUL', 'FAILED') then 100 else 50 end as percent
        from (select job_id, arg_max(case when status <> 'CREATED' then status end,
                                     case when status <> 'CREATED' then version end) as status
              from {TRANSITIONS} t group by job_id) p""",
)
check(
    "progress_of_submitted",
    ["job_changes_fx", "statuses_fx"],
    f"""select job_id,
               case status when 'SUCCESSFUL' then 'Conversion complete!' when 'FAILED' then 'Failed!'
                    else 'Converting...' end as display,
               case when status in ('SUCCESSFUL', 'FAILED') then 100 else 50 end as percent
        from (select job_id from job_changes_fx where kind = 'SUBMIT'
              union select job_id from {TRANSITIONS} t) j
        left join (select job_id, arg_max(status, version) as status
                   from {TRANSITIONS} t where status <> 'CREATED' group by job_id) p using (job_id)""",
)
check(
    "duplicate_files",
    [],
    """select sha256(text) as content_hash, count(*) as n, min(doc_id) as first_id
       from documents group by sha256(text) having count(*) > 1""",
)
check(
    "read_record_store",
    ["job_changes_fx"],
    """select version, job_id as id, case when kind <> 'DELETE' then store_name end as video,
              case kind when 'SUBMIT' then 'CREATED' when 'DELETE' then null else kind end as status,
              cast(version as varchar) as process,
              case kind when 'DELETE' then 'video.missing' when 'FAILED' then 'field.unknown' end as error_code
       from job_changes_fx""",
)
check(
    "write_record_store",
    ["job_changes_fx"],
    f"select job_id, store_name, kind, version from {latest('job_id')} l",
)
check(
    "append_completed",
    ["results_fx", "files_fx"],
    f"""select store_name, file_name from {COMPLETED} c
        where store_name in (select store_name from files_fx)""",
)
check(
    "encode_records",
    ["jobs_fx"],
    """select '{"id":"' || id || '","status":"' || status || '","failure_reason":'
              || coalesce('"' || failure_reason || '"', 'null') || ',"version":' || version || '}' as record
       from jobs_fx""",
)
check(
    "decode_records",
    ["jobs_fx"],
    """select id, status, file_name, version, null as error_code from jobs_fx where status <> 'FAILED'
       union all select id, null, null, null, 'record.malformed' from jobs_fx where status = 'FAILED'""",
)
check(
    "stream_transitions",
    ["statuses_fx"],
    f"""select job_id, version, status,
               row_number() over (partition by job_id order by ts, version) - 1 as seq
        from {TRANSITIONS} t""",
)
check("stream_canonical", ["job_changes_fx"], f"select * from {CANONICAL} c")
check("stream_split_logs", ["logs_fx"], f"select * from {EVENTS} e")
check(
    "upsert_stream",
    ["job_changes_fx"],
    """select job_id, store_name, kind, version from
         (select *, row_number() over (partition by job_id order by ts desc, version desc) as rn
          from job_changes_fx) l where rn = 1""",
)
check(
    "replay_and_tail",
    ["subscriptions_fx", "live_log_fx"],
    f"""select *, true as job_found from {TAILED} t
        union all
        select subscriber, job_id, null, null, null, false from {OFFSETS} s
        where error_code is null and job_id not in (select job_id from event_log_fx)""",
)
check(
    "stream_dedupe_delivery",
    ["subscriptions_fx", "live_log_fx"],
    f"""select subscriber, job_id, seq, name, data from {TAILED} t where name <> 'status'
        union all
        select subscriber, job_id, null, name, data from {TAILED} t, (values (1), (2)) copies
        where name = 'status'""",
)
check(
    "recent_conversions",
    ["submissions_fx", "jobs_fx", "files_fx"],
    f"""select e.id, e.file_name as name, a.video
        from {ENDED} e left join
             (select store_name, video from
                (select {STORE_NAME} as store_name, video, provider,
                        row_number() over (partition by {STORE_NAME} order by ts desc, submission_id desc) as rn
                 from {MATCHED} m where code is null and provider is not null) q where rn = 1) a
          on a.store_name = e.store_name
        where e.status = 'SUCCESSFUL' and e.end_ms >= {HISTORY_FROM_MS} and e.end_ms < {HISTORY_TO_MS}
        order by e.end_ms desc, e.id""",
)
