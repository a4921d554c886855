"""Streams over several files in arrival order give what the batch operators give."""

import random

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F
from test_logs import split_by_hand
from test_skew import CHANGES, by_key, change_log, replay_submissions

from joblens.operators import delivery, state
from joblens.session import scratch_dir
from joblens.streaming import batches
from joblens.streaming import delivery as live_delivery
from joblens.streaming import logs as live_logs
from joblens.streaming import run
from joblens.streaming import state as live_state


def in_files(spark, slices, schema, name):
    """A stream of one file per batch, in order."""
    path = scratch_dir(spark, name)
    for part in slices:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return run.read_table_stream(spark, path, maxFilesPerTrigger="1")


def slices(rows, count):
    return [rows[len(rows) * n // count : len(rows) * (n + 1) // count] for n in range(count)]


@pytest.fixture(scope="module")
def log():
    return sorted(change_log(400), key=lambda r: (r[3], r[4]))


def drained(stream, start, schema, **options):
    return batches.drain_batches(stream, "out", start, schema, **options)


SIZES = [SMALL | {"fold_every": 2}]


@pytest.mark.parametrize("sizes", SIZES)
def test_transitions(spark, log, sizes):
    rows = [(r[0], r[2], r[3], r[4]) for r in log]
    stream = in_files(spark, slices(rows, 4), "job_id string, status string, ts int, version bigint", "in")
    schema = live_state.transitions_schema(stream)
    got = drained(stream, live_state.stream_transitions, schema, **sizes).select("version", "seq", "status")
    want = []
    for events in by_key(log, 0).values():
        last, seq = "CREATED", 0
        for row in events:
            if row[2] != last:
                want.append((row[4], seq, row[2]))
                last, seq = row[2], seq + 1
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("sizes", SIZES)
def test_canonical(spark, log, sizes):
    stream = in_files(spark, slices(log, 4), CHANGES, "in")
    got = drained(stream, live_state.stream_canonical, live_state.canonical_schema(stream), **sizes)
    owners, _ = replay_submissions(log)
    assert rows_of(got) == sorted(owners, key=repr)


def test_a_repeated_batch_changes_nothing(spark, log):
    """As after a lost commit: the checkpoint is gone, the tables are there."""
    base = scratch_dir(spark, "repeated")
    stream = in_files(spark, slices(log, 3), CHANGES, "in")
    want = None
    for _ in range(2):
        live_state.stream_canonical(stream, base, **SMALL).awaitTermination()
        got = rows_of(batches.stored(spark, base, "out", live_state.canonical_schema(stream)))
        want = want or got
        assert got == want
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def test_state_of_ended_keys_is_gone(spark):
    columns = "k string, v int"
    state = batches.KeyedState(spark, scratch_dir(spark, "state"), "k", columns, fold_every=3)
    alive = {}
    draw = random.Random(4)
    for number in range(10):
        assert rows_of(state.before(number)) == sorted(alive.items())
        rows = [(f"k{k}", number, draw.random() < 0.4) for k in draw.sample(range(8), 3)]
        state.write(spark.createDataFrame(rows, f"{columns}, gone boolean"), number)
        for key, value, gone in rows:
            alive.pop(key, None)
            if not gone:
                alive[key] = value
    written = spark.read.parquet(f"{state.base}/state/batch=9")
    assert written.where("gone").count() == 0


@pytest.mark.parametrize("sizes", SIZES)
def test_split_logs_cut_anywhere(spark, sizes):
    draw = random.Random(2)
    texts = [
        "".join(draw.choice(["a", "é", "\r", "\n", "日"]) for _ in range(draw.randrange(40))).encode()
        for _ in range(25)
    ]
    pieces = [[] for _ in range(3)]
    for job, text in enumerate(texts):
        cuts = [0, *sorted(draw.randrange(len(text) + 1) for _ in range(5)), len(text)]
        for part in range(6):
            piece = bytearray(text[cuts[part] : cuts[part + 1]])
            pieces[part // 2].append((job, part, piece, part == 5))
    stream = in_files(
        spark, pieces, "job_id int, part int, piece binary, is_last boolean", "pieces"
    )
    got = drained(stream, live_logs.stream_split_logs, live_logs.log_events_schema(stream), **sizes)
    want = [
        (job, seq, *event)
        for job, text in enumerate(texts)
        for seq, event in enumerate(split_by_hand(text))
    ]
    assert rows_of(got) == sorted(want, key=repr)


def test_a_hot_log_over_many_pieces(spark):
    """A third of all pieces in one log, lines over several pieces, and no state once it has ended."""
    draw = random.Random(6)
    texts = {0: "".join(draw.choice(["ab", "é", "\n", "\r", "日", "x" * 9]) for _ in range(900)).encode()}
    texts |= {job: f"log {job}\nopen {job}".encode() for job in range(1, 150)}
    texts[150] = ("no terminator " * 40).encode()
    rows = []
    for job, text in texts.items():
        size = 7 if job in (0, 150) else 30
        parts = [text[at : at + size] for at in range(0, len(text), size)]
        rows += [(job, part, bytearray(p), part == len(parts) - 1) for part, p in enumerate(parts)]
    by_turn = [[r for r in rows if min(r[1] * 4 // (400 if r[0] == 0 else 1 if r[0] != 150 else 80), 3) == n] for n in range(4)]
    stream = in_files(spark, by_turn, "job_id int, part int, piece binary, is_last boolean", "pieces")
    base = scratch_dir(spark, "hot-log")
    live_logs.stream_split_logs(stream, base, **SMALL).awaitTermination()
    got = batches.stored(spark, base, "out", live_logs.log_events_schema(stream)).drop("batch")
    want = [(job, seq, *e) for job, text in texts.items() for seq, e in enumerate(split_by_hand(text))]
    assert rows_of(got) == sorted(want, key=repr)
    state = batches.KeyedState(spark, base, "job_id", "job_id int, piece binary, sent bigint")
    assert state.before(4).count() == 0
    assert state.before(1).count() > 0


@pytest.mark.parametrize("merge_every", [2, 32])
def test_upserts_survive_a_repeated_batch(spark, log, merge_every):
    base = scratch_dir(spark, "upserts")
    stream = in_files(spark, slices(log, 4), CHANGES, "in")
    live_state.upsert_stream(
        stream, f"{base}/table", "job_id", f"{base}/checkpoint", merge_every
    ).awaitTermination()
    want = rows_of(state.latest_by(spark.createDataFrame(log, CHANGES), "job_id"))
    assert rows_of(live_state.read_upserts(spark, f"{base}/table", "job_id")) == want
    # The same batches again, as after a lost checkpoint commit.
    live_state.upsert_stream(
        stream, f"{base}/table", "job_id", f"{base}/checkpoint-2", merge_every
    ).awaitTermination()
    assert rows_of(live_state.read_upserts(spark, f"{base}/table", "job_id")) == want


EVENTS = "job_id int, seq bigint, name string, data string, ts timestamp"


def test_follow(spark):
    events = [(job, seq, "outputLine", f"{job}:{seq}", seq) for seq in range(6) for job in (1, 2)]
    stream = in_files(
        spark, slices(events, 3), "job_id int, seq bigint, name string, data string, at int", "in"
    ).withColumn("ts", F.timestamp_seconds("at"))
    asks = spark.createDataFrame(
        [(10, 1, 2, 99), (11, 1, 5, 3), (12, 2, 0, 0), (13, 7, 0, 0)],
        "subscriber int, job_id int, skip bigint, at int",
    ).withColumn("subscribed_at", F.timestamp_seconds("at"))
    tail = live_delivery.follow(stream, asks).drop("ts")
    got = run.drain(tail, "tail").select("subscriber", "seq")
    want = [(10, s) for s in (2, 3, 4, 5)] + [(11, s) for s in (3, 4, 5)] + [(12, s) for s in range(6)]
    assert rows_of(got) == sorted(want)


ASKS = "subscriber int, job_id int, skip bigint, at int"


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_and_tail_with_subscriptions_at_any_time(spark, seed):
    draw = random.Random(seed)
    events = [(job, seq, "outputLine", f"{job}:{seq}", seq) for seq in range(12) for job in (1, 2, 3)]
    asks = [(n, draw.choice([1, 1, 2, 3, 77]), draw.randrange(14), draw.randrange(14)) for n in range(60)]
    log = in_files(spark, slices(events, 3), "job_id int, seq bigint, name string, data string, at int", "in")
    log = log.withColumn("ts", F.timestamp_seconds("at"))
    turns = [[] for _ in range(6)]
    for ask in asks:
        turns[draw.randrange(6)].append(ask)
    asked = in_files(spark, turns, ASKS, "asks").withColumn("subscribed_at", F.timestamp_seconds("at"))
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    base = scratch_dir(spark, "tail")
    live_delivery.replay_and_tail(log, asked, base, jobs).awaitTermination()
    out = batches.stored(spark, base, "out", live_delivery.deliveries_schema(log, asked))
    got = out.select("subscriber", "job_id", "seq", "job_found")
    want = [
        (n, job, e[1], True)
        for n, job, skip, at in asks
        for e in events
        if e[0] == job and (e[1] >= skip or e[4] >= at)
    ]
    want += [(n, job, None, False) for n, job, _, _ in asks if job == 77]
    assert rows_of(got) == sorted(want, key=repr)


def test_a_job_is_known_once_its_log_has_an_event(spark):
    events = [[(1, 0, "outputLine", "x", 0)], [(2, 0, "outputLine", "y", 0)], [(1, 1, "outputLine", "z", 1)]]
    log = in_files(spark, events, "job_id int, seq bigint, name string, data string, at int", "in")
    log = log.withColumn("ts", F.timestamp_seconds("at"))
    asks = [[(10, 2, 0, 0), (11, 1, 0, 0)], [(12, 2, 0, 0)], []]
    asked = in_files(spark, asks, ASKS, "asks").withColumn("subscribed_at", F.timestamp_seconds("at"))
    base = scratch_dir(spark, "tail")
    live_delivery.replay_and_tail(log, asked, base).awaitTermination()
    out = batches.stored(spark, base, "out", live_delivery.deliveries_schema(log, asked))
    want = [(10, 2, None, False), (11, 1, 0, True), (11, 1, 1, True), (12, 2, 0, True)]
    assert rows_of(out.select("subscriber", "job_id", "seq", "job_found")) == sorted(want, key=repr)


@pytest.mark.parametrize("within", [None, "1 hour"])
def test_dedupe_across_batches(spark, within):
    rows = [(1, 1, 0, 0), (1, 1, 0, 1), (1, 1, None, 2), (2, 1, 0, 2)]
    schema = "subscriber int, job_id int, seq bigint, at int"
    stream = in_files(spark, [rows, rows, rows[:1]], schema, "in").withColumn(
        "ts", F.timestamp_seconds("at")
    )
    got = run.drain(live_delivery.stream_dedupe_delivery(stream, within), "out")
    want = [(1, 0), (1, None), (1, None), (2, 0)]
    assert rows_of(got.select("subscriber", "seq")) == sorted(want, key=repr)
    batch = delivery.dedupe_delivery(spark.createDataFrame(rows * 2 + rows[:1], schema), "at")
    assert rows_of(batch.select("subscriber", "seq")) == sorted(want, key=repr)


def test_another_checkpoint_adds_its_rows(spark, log):
    base = scratch_dir(spark, "upserts")
    half = len(log) // 2
    for number, rows in enumerate((log[:half], log[half:])):
        stream = in_files(spark, slices(rows, 2), CHANGES, "in")
        live_state.upsert_stream(
            stream, f"{base}/table", "job_id", f"{base}/checkpoint-{number}"
        ).awaitTermination()
    want = rows_of(state.latest_by(spark.createDataFrame(log, CHANGES), "job_id"))
    assert rows_of(live_state.read_upserts(spark, f"{base}/table", "job_id")) == want
