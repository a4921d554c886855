import pytest
from conftest import rows_of

from joblens.operators import delivery, lookups, state


def test_latest_by_takes_time_then_version(spark):
    df = spark.createDataFrame(
        [("a", "SUBMIT", 1, 1), ("a", "FAILED", 2, 0), ("a", "CONVERTING", 2, 3), ("b", "DELETE", 9, 9)],
        "job_id string, kind string, ts int, version int",
    )
    assert rows_of(state.latest_by_id(df)) == [("a", "CONVERTING", 2, 3)]


def test_classify_outcomes(spark):
    df = spark.createDataFrame(
        [(0, "f", None), (0, None, None), (3, "f", None), (None, None, "lost")],
        "exit_code int, result_name string, exception_text string",
    )
    got = state.classify_outcomes(df).select("status", "failure_reason").collect()
    assert [tuple(row) for row in got] == [
        ("SUCCESSFUL", None),
        ("FAILED", "Error: no result given"),
        ("FAILED", "Bad Exit Code 3"),
        ("FAILED", "Error: lost"),
    ]


def test_delete_keeps_other_jobs_of_the_store_name(spark):
    by_id = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "id string, store_name string")
    stores = spark.createDataFrame([("s",), ("t",)], "store_name string")
    ids = spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    left = state.cascade_delete(ids, by_id, stores, stores, stores)
    assert rows_of(left.by_id) == [("b", "s"), ("c", "t")]
    assert rows_of(left.by_store) == rows_of(left.completed) == rows_of(left.files) == [("t",)]
    assert rows_of(left.not_found) == [("x",)]


def test_delete_reads_every_table_once(spark, tmp_path):
    columns = "id string, store_name string, v int"
    tables = {
        "ids": spark.createDataFrame([("a",), ("x",), ("a",)], "id string"),
        "by_id": spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "t", 3), ("d", None, 4)], columns),
        "by_store": spark.createDataFrame([("b", "s", 5), ("c", "t", 6)], columns),
        "completed": spark.createDataFrame([("s", "f"), ("t", "g")], "store_name string, file_name string"),
        "files": spark.createDataFrame([("s", 1), ("u", 2)], "store_name string, end_ms bigint"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{name}") for name in tables]
    marks = state.cascade_marks(*stored)
    marks.collect()
    plan = marks._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("\n+- == Initial Plan ==")]
    own = [line for line in final.splitlines() if "FileScan parquet" in line]
    assert len({line.split("FileScan")[1] for line in own}) == 5
    left = state.cascade_delete(*stored)
    assert rows_of(left.by_id) == [("b", "s", 2), ("c", "t", 3), ("d", None, 4)]
    assert rows_of(left.by_store) == [("c", "t", 6)]
    assert rows_of(left.completed) == [("t", "g")]
    assert rows_of(left.files) == [("u", 2)]
    assert rows_of(left.not_found) == [("x",)]


def test_history_range_reaches_the_scan(spark, tmp_path):
    jobs = [(f"j{n}", f"s{n}", "SUCCESSFUL", f"n{n}") for n in range(8)]
    spark.createDataFrame(jobs, "id string, store_name string, status string, file_name string").write.parquet(f"{tmp_path}/jobs")
    files = [(f"s{n}", None if n == 6 else n * 10) for n in range(7)]
    spark.createDataFrame(files, "store_name string, end_ms bigint").write.parquet(f"{tmp_path}/files")
    jobs_, files_ = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("jobs", "files"))
    ends = {f"j{n}": n * 10 if n < 6 else 0 for n in range(8)}
    for low, high in [(20, 50), (0, 20), (None, 30), (20, None), (None, None), (-5, 1), (1, 1)]:
        rows, _ = lookups.history(jobs_, files_, low, high)
        want = [(i, f"n{i[1:]}") for i, e in ends.items() if (low is None or e >= low) and (high is None or e < high)]
        assert rows_of(rows) == sorted(want)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        if low is not None and low > 0:
            assert "LeftAnti" not in plan
        if low is not None and (high is None or high > low):
            assert f"GreaterThanOrEqual(end_ms,{low})" in plan


def test_purge_drops_unknown_status(spark):
    df = spark.createDataFrame([("a", None), ("b", "SUCCESSFUL"), ("c", "FAILED")], "s string, status string")
    assert rows_of(state.purge_resubmit(df)) == [("b", "SUCCESSFUL")]


def test_split_cached(spark):
    submissions = spark.createDataFrame([(1, "s"), (2, "t"), (3, "s")], "submission_id int, store_name string")
    completed = spark.createDataFrame([("s", "f.mp3")], "store_name string, file_name string")
    hits, misses = state.split_cached(submissions, completed)
    assert rows_of(hits.select("submission_id", "file_name", "status")) == [
        (1, "f.mp3", "SUCCESSFUL"),
        (3, "f.mp3", "SUCCESSFUL"),
    ]
    assert rows_of(misses.select("submission_id")) == [(2,)]


def test_disconnected_store_names_are_stale_once_submitted_again(spark):
    schema = "store_name string, kind string, ts int, version int"
    files = spark.createDataFrame([("s", 1), ("t", 2), ("u", 3)], "store_name string, length int")
    entries = spark.createDataFrame(
        [("s", "a", 5, 1), ("t", "b", 5, 2), ("u", "c", 5, 3)],
        "store_name string, job_id string, ts int, version int",
    )
    gone = state.audit_disconnects(entries, spark.createDataFrame([("b",)], "job_id string"))
    assert rows_of(gone.select("job_id", "store_name")) == [("a", "s"), ("c", "u")]
    assert rows_of(state.stale_results(spark.createDataFrame([], schema), files, gone)) == []
    again = [("s", "SUBMIT", 6, 9), ("u", "SUBMIT", 4, 8), ("t", "SUBMIT", 7, 9)]
    changes = spark.createDataFrame(again, schema)
    assert rows_of(state.stale_results(changes, files, gone)) == [("s", 1)]


def test_a_run_without_exit_code_has_no_status(spark):
    rows = spark.createDataFrame(
        [(1, None, None, "f"), (2, 0, None, "f"), (3, None, "x", "f"), (4, 2, None, "f")],
        "version int, exit_code int, exception_text string, result_name string",
    )
    found = state.classify_outcomes(rows).select("version", "status", "error_code")
    assert rows_of(found) == [
        (1, None, "exit_code.missing"),
        (2, "SUCCESSFUL", None),
        (3, "FAILED", None),
        (4, "FAILED", None),
    ]


@pytest.mark.parametrize(
    "text,skip,error",
    [
        (None, 0, None),
        ("", 0, None),
        ("abc", 0, None),
        (" 5", 0, None),
        ("5\n", 0, None),
        ("+5", 6, None),
        ("-1", 0, None),
        ("-2", -1, "skip.negative"),
        ("2147483646", 2147483647, None),
        ("2147483647", 2147483648, "skip.negative"),
        ("2147483648", 0, None),
        ("99999999999999999999", 0, None),
    ],
)
def test_resume_offsets(spark, text, skip, error):
    df = spark.createDataFrame([(1, text)], "subscriber int, last_event_id string")
    row = delivery.check_resume_offsets(df).first()
    assert (row.skip, row.error_code) == (skip, error)


def test_dedupe_keeps_the_first_and_all_without_id(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, "late", 2), (1, 1, 0, "early", 1), (1, 1, None, "k", 1), (1, 1, None, "k", 2),
         (2, 1, 0, "late", 2)],
        "subscriber int, job_id int, seq int, data string, arrival int",
    )
    got = delivery.dedupe_delivery(df, "arrival").select("subscriber", "seq", "data")
    assert rows_of(got) == [(1, 0, "early"), (1, None, "k"), (1, None, "k"), (2, 0, "late")]
    assert delivery.dedupe_delivery(df).count() == 4


def test_parse_range():
    assert lookups.parse_range() == (None, None)
    assert lookups.parse_range(["5", "x"], ["5"]) == (5, 5)
    assert lookups.parse_range(["x", "5"], ["9.5"]) == (None, None)
    assert lookups.parse_range(["9223372036854775808"], ["-3"]) == (None, -3)
    with pytest.raises(ValueError, match="from.too.small"):
        lookups.parse_range(["-1"])
    with pytest.raises(ValueError, match="to.too.small"):
        lookups.parse_range(["2"], ["1"])


def test_parse_ranges_agree_with_parse_range(spark):
    texts = [None, "x", "-1", "+4", "4", "7", "9223372036854775808", " 1"]
    df = spark.createDataFrame([(f, t) for f in texts for t in texts], "`from` string, `to` string")
    for row in lookups.check_ranges(df).collect():
        try:
            want = (*lookups.parse_range(*[[v] if v is not None else [] for v in (row["from"], row.to)]), None)
        except ValueError as error:
            want = (row.from_ms, row.to_ms, str(error))
        assert (row.from_ms, row.to_ms, row.error_code) == want


JOBS = "id string, store_name string, status string, failure_reason string, file_name string"


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        [
            ("ok", "s1", "SUCCESSFUL", None, "a.mp3"),
            ("gone", "s2", "SUCCESSFUL", None, "b.mp3"),
            ("nameless", "s3", "SUCCESSFUL", None, None),
            ("bad", "s4", "FAILED", "why", None),
            ("odd", "s5", "FAILED", None, None),
            ("busy", "s6", "CONVERTING", None, None),
        ],
        JOBS,
    )


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        [("s1", 100, 7), ("s3", 50, 8)], "store_name string, end_ms bigint, length bigint"
    )


def test_history(jobs, files):
    rows, bad = lookups.history(jobs, files)
    assert [tuple(row) for row in rows.collect()] == [("ok", "a.mp3"), ("gone", "b.mp3")]
    assert rows_of(bad.select("id", "error_code")) == [("nameless", "name.missing")]
    assert [r.id for r in lookups.history(jobs, files, 0, 100)[0].collect()] == ["gone"]
    assert [r.id for r in lookups.history(jobs, files, 100)[0].collect()] == ["ok"]
    assert lookups.history(jobs, files, 100, 100)[0].count() == 0


def test_lookups(spark, jobs, files):
    ids = spark.createDataFrame(
        [(i,) for i in ("ok", "gone", "nameless", "bad", "odd", "busy", "none", "ok")], "id string"
    )
    assert rows_of(lookups.status_of(ids, jobs)) == [
        ("bad", "FAILED", "why", None),
        ("busy", "CONVERTING", None, None),
        ("gone", "SUCCESSFUL", None, None),
        ("nameless", "SUCCESSFUL", None, None),
        ("none", None, None, "not_found"),
        ("odd", "FAILED", None, "reason.missing"),
        ("ok", "SUCCESSFUL", None, None),
    ]
    found = lookups.property_of(ids, jobs, "file_name").where("error_code is null")
    assert rows_of(found.select("id", "value")) == [("gone", "b.mp3"), ("ok", "a.mp3")]
    manifest = lookups.export_manifest(ids, jobs, files)
    assert rows_of(manifest.select("id", "code", "error_code", "status", "content_length")) == [
        ("bad", 409, "conversion.failed", None, None),
        ("busy", 409, "conversion.not.finished", "CONVERTING", None),
        ("gone", 500, "file.missing", None, None),
        ("nameless", 500, "name.missing", None, None),
        ("none", 404, "not_found", None, None),
        ("odd", 409, "conversion.failed", None, None),
        ("ok", 200, None, None, 7),
    ]


def test_progress_ignores_other_events_and_unknown_states(spark):
    df = spark.createDataFrame(
        [("a", 0, "status", "CONVERTING"), ("a", 1, "status", "SUCCESSFUL"), ("a", 2, "outputLine", "FAILED"),
         ("a", 3, "status", "CREATED"), ("b", 0, "outputLine", "x"), ("c", 0, "status", "FAILED")],
        "job_id string, seq int, name string, data string",
    )
    assert rows_of(lookups.progress_view(df)) == [
        ("a", "Conversion complete!", 100),
        ("b", "Converting...", 50),
        ("c", "Failed!", 100),
    ]


def test_progress_of_a_submitted_job_without_events(spark):
    events = spark.createDataFrame(
        [("a", 0, "status", "FAILED"), ("d", 0, "status", "SUCCESSFUL")],
        "job_id string, seq int, name string, data string",
    )
    submitted = spark.createDataFrame([("a",), ("b",), ("b",)], "job_id string")
    assert rows_of(lookups.progress_view(events, submitted=submitted)) == [
        ("a", "Failed!", 100),
        ("b", "Converting...", 50),
        ("d", "Conversion complete!", 100),
    ]
