import hashlib
import json
import os
import time

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException

from joblens.session import scratch_dir
from joblens.sources import completed, records, results, snapshots


def store(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_read_record_store(spark, tmp_path):
    good = {"id": "a", "video": 5, "status": "FAILED", "failureReason": None, "process": True,
            "storeName": "s", "events": [{"name": "n", "id": "0", "data": "d"}, {"name": None}]}
    entries = {
        "good": good,
        "no id": {"video": "v"},
        "null video": {"id": "x", "video": None},
        "unknown field": {"id": "x", "video": "v", "extra": 1},
        "nested": {"id": {"a": 1}, "video": "v"},
        "status": {"id": "x", "video": "v", "status": "DONE"},
        "events": {"id": "x", "video": "v", "events": "no"},
        "text": "x",
        "null": None,
    }
    paths = [
        store(tmp_path, "a.json", json.dumps(entries, indent=2)),
        store(tmp_path, "b.json", "[]"),
        store(tmp_path, "c.json", "{}"),
        store(tmp_path, "d.json", '{"again": {"id": 1}, "again": {"id": "z", "video": "w"}}'),
        str(tmp_path / "missing.json"),
    ]
    rows, bad = records.read_record_store(spark, paths)
    got = {row.key: row for row in rows.collect()}
    assert sorted(got) == ["again", "good"]
    assert got["again"].id == "z"
    row = got["good"]
    assert (row.id, row.video, row.status, row.failure_reason, row.process) == ("a", "5", "FAILED", None, "true")
    assert [tuple(event) for event in row.events] == [("n", "0", "d"), (None, None, None)]
    assert rows_of(bad.select("key", "error_code")) == [
        ("events", "field.malformed"),
        ("nested", "field.malformed"),
        ("no id", "id.missing"),
        ("null video", "video.missing"),
        ("null", "entry.not.object"),
        ("status", "status.unknown"),
        ("text", "entry.not.object"),
        ("unknown field", "field.unknown"),
    ]


def test_repeated_keys_take_linear_time(spark):
    """The last entry of a key counts; four times the repeats take about four times as long."""

    def seconds(n: int) -> float:
        entries = ",".join(['"k": {"id": "old", "video": "v"}'] * n + [f'"k{i}": {{"id": "{i}", "video": "v"}}' for i in range(3)])
        files = spark.createDataFrame([("f", "{%s, \"k\": {\"id\": \"new\", \"video\": \"v\"}}" % entries)], "file string, value string")
        start = time.perf_counter()
        rows = records.decode_entries(files).select("key", "id").collect()
        assert sorted(map(tuple, rows)) == [("k", "new"), *[(f"k{i}", str(i)) for i in range(3)]]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 8 * seconds(10_000) + 2


def test_missing_and_malformed_files(spark, tmp_path):
    rows, bad = records.read_record_store(spark, str(tmp_path / "none.json"))
    assert rows.count() == bad.count() == 0
    path = store(tmp_path, "cut.json", '{"a": {"id": "x", "vid')
    with pytest.raises(PySparkException, match="malformed snapshot file"):
        records.read_record_store(spark, path)[0].collect()


def test_snapshot_is_replaced_whole_and_readers_follow_the_pointer(spark):
    path = scratch_dir(spark, "snapshot")
    assert snapshots.read_parts(spark, path) is None
    snapshots.write_record_store(spark.range(3), path, 0)
    before = snapshots.read_parts(spark, path)
    snapshots.write_record_store(spark.range(5), path, 1)
    snapshots.write_record_store(spark.range(5), path, 1)
    assert snapshots.read_parts(spark, path).count() == 5
    assert before.count() == 3
    # A version that was written but not published is not seen.
    spark.range(9).write.parquet(f"{path}/{snapshots.part_name('base', 2)}")
    assert snapshots.read_parts(spark, path).count() == 5
    assert [name for name in os.listdir(path) if "current" in name and not name.endswith(".crc")] == [
        snapshots.POINTER
    ]


def test_append_part_is_idempotent(spark):
    path = scratch_dir(spark, "parts")
    for version in (0, 1, 1, 0):
        snapshots.append_part(spark.range(2), path, version)
    assert snapshots.read_parts(spark, path).count() == 4


def test_completed_records(spark):
    path = scratch_dir(spark, "completed")
    assert completed.read_completed(spark, path).count() == 0
    rows = "store_name string, file_name string"
    completed.append_completed(spark.createDataFrame([("a", "1"), ("b", "1")], rows), path)
    completed.append_completed(spark.createDataFrame([("a", "0")], rows), path)
    assert rows_of(completed.read_completed(spark, path)) == [("a", "0"), ("b", "1")]
    completed.remove_completed(spark.createDataFrame([("a",)], "store_name string"), path)
    assert rows_of(completed.read_completed(spark, path)) == [("b", "1")]
    completed.append_completed(spark.createDataFrame([("a", "2")], rows), path)
    assert rows_of(completed.read_completed(spark, path)) == [("a", "2"), ("b", "1")]


def test_scan_results_does_not_read_contents(spark, tmp_path):
    for name, when in (("s one", 1000), ("s+é", 2500)):
        path = tmp_path / name
        path.write_bytes(b"x" * when)
        os.utime(path, (when, when))
    files = results.scan_results(spark, str(tmp_path))
    assert rows_of(files.select("store_name", "end_ms", "length")) == [
        ("s one", 1_000_000, 1000),
        ("s+é", 2_500_000, 2500),
    ]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_duplicate_files_hash_all_bytes(spark, tmp_path):
    for name, data in (("a", b"\x00\xff"), ("b", b"\x00\xff"), ("c", b"")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = results.duplicate_files(files, "path", "content").collect()
    assert [(r.content_hash, r.n, r.first_id[-2:]) for r in got] == [
        (hashlib.sha256(b"\x00\xff").hexdigest(), 2, "/a")
    ]


def test_records_round_trip(spark):
    rows = [("a", None, 'quote " and \n line', 1), (None, "é", None, None)]
    df = spark.createDataFrame(rows, "id string, video string, reason string, version bigint")
    texts = records.encode_records(df)
    assert '"video":null' in texts.first().record
    back, bad = records.decode_records(texts, df.schema)
    assert rows_of(back) == sorted(rows, key=repr)
    assert bad.count() == 0
    broken = spark.createDataFrame([("{",), ('{"version":"x"}',), (None,)], "record string")
    back, bad = records.decode_records(broken, df.schema)
    assert back.count() == 0 and bad.count() == 3


def test_a_lower_version_is_refused_and_old_readers_keep_their_state(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.write_record_store(spark.range(3), path)
    reader = snapshots.read_parts(spark, path)
    snapshots.write_record_store(snapshots.read_parts(spark, path).where("id > 0"), path)
    assert reader.count() == 3 and snapshots.read_parts(spark, path).count() == 2
    snapshots.append_part(spark.range(2), path, 5)
    with pytest.raises(ValueError, match="comes after"):
        snapshots.append_part(spark.range(2), path, 3)
