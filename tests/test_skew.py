"""Hot keys: the cut-up plans give what the plain ones give, and what a plain loop gives."""

import random

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from joblens.operators import delivery, logs, lookups, resolve, state
from joblens.plans import blocks, ordered
from joblens.sources import records

KINDS = ["SUBMIT", "CONVERTING", "FAILED", "SUCCESSFUL", "DELETE"]


def change_log(n=3000, seed=7):
    """A third of all rows in one store name, many of them at one time; times out of id order."""
    draw = random.Random(seed)
    versions = list(range(n))
    draw.shuffle(versions)
    rows = []
    for at, version in enumerate(versions):
        store = "hot" if at % 3 == 0 else f"s{draw.randrange(200)}"
        ts = 50 if at % 4 == 0 else at % 100
        job = f"{store}-{draw.randrange(2)}"
        rows.append((store, job, draw.choice(KINDS), ts, version))
    return rows


CHANGES = "store_name string, job_id string, kind string, ts int, version bigint"


@pytest.fixture(scope="module")
def log():
    return change_log()


@pytest.fixture(scope="module")
def changes(spark, log):
    return spark.createDataFrame(log, CHANGES).repartition(7).cache()


def by_key(log, column):
    groups = {}
    for row in sorted(log, key=lambda r: (r[3], r[4])):
        groups.setdefault(row[column], []).append(row)
    return groups


def chunk_counts(chunks):
    counted = chunks.rows.groupBy(ordered.KEY).agg(F.countDistinct(ordered.CHUNK).alias("n"))
    return {row[0][0]: row.n for row in counted.collect()}


def test_only_hot_keys_are_cut_and_every_chunk_is_small(changes):
    chunks = ordered.Chunks(changes, ["store_name"], ["ts", "version"], **SMALL)
    counts = chunk_counts(chunks)
    assert counts["hot"] > 50
    assert sum(1 for n in counts.values() if n > 1) == 1
    largest = chunks.rows.groupBy("store_name", ordered.CHUNK).count().agg(F.max("count"))
    assert largest.first()[0] < 100


def test_rows_are_shuffled_once(spark, changes, tmp_path):
    """One read for the sketch, one for the rows: every summary is made from the shuffled rows."""
    changes.write.parquet(f"{tmp_path}/changes")
    stored = spark.read.parquet(f"{tmp_path}/changes")
    for rows, summaries in (
        (logs.number_events(stored.drop("kind"), ["ts", "version"], "store_name", **SMALL), 1),
        (logs.status_transitions(stored, ["ts", "version"], "store_name", "kind", **SMALL), 1),
        (state.assign_canonical(stored, **SMALL), 1),
        (state.stale_stores(stored, **SMALL), 1),
    ):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        steps = [line.strip(" :+-") for line in plan[: plan.index("\n+- == Initial Plan ==")].splitlines()]
        own = [s for s in steps if s.startswith("Exchange hashpartitioning(_key") and "_chunk" in s]
        reused = [s for s in steps if s.startswith("ReusedExchange") and "_chunk" in s]
        assert len(reused) >= summaries
        assert len({s.split("plan_id=")[1] for s in own}) == 1


def test_null_keys_are_cut_like_others(spark):
    keys = [None] * 600 + ["hot"] * 600 + [f"k{n}" for n in range(300)]
    rows = [(key, at % 7, at) for at, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "job_id string, ts int, version bigint").repartition(5)
    chunks = ordered.Chunks(df, ["job_id"], ["ts", "version"], **SMALL)
    counts = chunk_counts(chunks)
    assert counts[None] > 20 and counts["hot"] > 20 and counts["k5"] == 1
    got = logs.number_events(df, ["ts", "version"], **SMALL)
    want = [
        (row[2], at)
        for key in set(keys)
        for at, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]))
    ]
    assert rows_of(got.select("version", "seq")) == sorted(want, key=repr)


ORDERED = [
    ("timestamp_ntz", [f"2024-03-31 0{n % 4}:{n % 60:02d}:{n * 7 % 60:02d}.{n:06d}" for n in range(300)]),
    ("timestamp", [f"2024-10-27 0{n % 4}:{n % 60:02d}:{n * 7 % 60:02d}" for n in range(300)]),
    ("date", [f"{1960 + n % 80}-01-{n % 28 + 1:02d}" for n in range(300)]),
    ("string", ["", "a", "b" * 40, "b" * 40 + "c", "ä", "日本", "b" * 7, "b" * 6 + "a", *map(str, range(200))]),
    ("bigint", [-(2**63), 2**63 - 1, *range(-100, 100)]),
    ("boolean", ["true", "false"]),
]


@pytest.mark.parametrize("kind,values", ORDERED)
def test_images_rise_with_the_order(spark, kind, values):
    df = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "text string")
    df = df.select(F.col("text").cast(kind).alias("v"))
    images = F.struct(*ordered.order_values(df, "v"))
    rows = df.select("v", images.alias("image")).orderBy("v").collect()
    assert [r.image for r in rows] == sorted(r.image for r in rows)


def test_an_order_that_cannot_be_cut_is_an_error(spark):
    with pytest.raises(TypeError, match="order of x"):
        ordered.Chunks(spark.range(3).selectExpr("id", "cast(id as double) as x"), ["id"], ["x"])


def test_number_events(changes, log):
    got = logs.number_events(changes, ["ts", "version"], "store_name", **SMALL)
    want = [
        (row[4], at) for rows in by_key(log, 0).values() for at, row in enumerate(rows)
    ]
    assert rows_of(got.select("version", "seq")) == sorted(want, key=repr)


def test_status_transitions(changes, log):
    got = logs.status_transitions(changes, ["ts", "version"], "store_name", "kind", **SMALL)
    want = []
    for rows in by_key(log, 0).values():
        last = "CREATED"
        for row in rows:
            if row[2] != last:
                want.append((row[4], row[2]))
            last = row[2]
    assert rows_of(got.select("version", "kind")) == sorted(want, key=repr)


def replay_submissions(log):
    """One store name after the other: who owns each submission, and which stores were stale."""
    owners, stale = [], set()
    for store, rows in by_key(log, 0).items():
        active, failed = None, False
        for row in rows:
            if row[2] == "SUBMIT":
                if failed:
                    stale.add(store)
                if active is None or failed:
                    active, failed = row[4], False
                owners.append((row[4], store, active))
            elif row[2] == "FAILED":
                failed = active is not None
            elif row[2] == "DELETE":
                active, failed = None, False
    return owners, stale


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_assign_canonical(changes, log, sizes):
    owners, _ = replay_submissions(log)
    assert rows_of(state.assign_canonical(changes, **sizes)) == sorted(owners, key=repr)


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_stale_results(spark, changes, log, sizes):
    _, stale = replay_submissions(log)
    files = changes.select("store_name").distinct()
    assert rows_of(state.stale_results(changes, files, **sizes)) == [(s,) for s in sorted(stale)]


def test_canonical_over_long_stretches_without_a_start(spark):
    """Chunks without any start take the owner from far back."""
    rows = [("hot", "j", "SUBMIT", at, at) for at in range(2000)]
    rows += [("hot", "j", "FAILED", 1000, 5000)]
    df = spark.createDataFrame(rows, CHANGES)
    got = state.assign_canonical(df, **SMALL).collect()
    assert {(r.version <= 1000, r.canonical) for r in got} == {(True, 0), (False, 1001)}


def test_assign_job_ids_counts_equal_times(spark, changes):
    df = changes.select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("version").alias("submission_id")
    )
    cut = resolve.assign_job_ids(df, seed="x", **SMALL)
    plain = resolve.assign_job_ids(df, seed="x")
    assert rows_of(cut.select("submission_id", "job_id")) == rows_of(
        plain.select("submission_id", "job_id")
    )
    assert cut.select("job_id").distinct().count() == df.count()
    again = resolve.assign_job_ids(df.repartition(3), seed="x", **SMALL)
    assert rows_of(again.select("submission_id", "job_id")) == rows_of(
        plain.select("submission_id", "job_id")
    )


def event_log(seed=3):
    """Output of a hot job and of small ones, status events in between, one job ending in returns."""
    draw = random.Random(seed)
    rows = []
    for job, size in [(0, 900), *[(job, 12) for job in range(1, 80)]]:
        seq = 0
        while seq < size:
            rows.append((job, seq, "outputLine", f"{job}:{seq}"))
            seq += 1
            if draw.random() < 0.2:
                rows.append((job, seq, "status", "CONVERTING"))
                seq += 1
            if draw.random() < 0.4:
                rows.append((job, seq, "carriageReturn", ""))
                seq += 1
    return rows


EVENTS = "job_id bigint, seq bigint, name string, data string"


def shown_lines(log):
    want = []
    for job in {row[0] for row in log}:
        shown, pending = [], False
        for row in sorted(r for r in log if r[0] == job):
            if row[2] == "outputLine":
                if pending:
                    shown.pop()
                    pending = False
                shown.append((row[0], row[1], row[3]))
            elif row[2] == "carriageReturn":
                pending = True
        want += shown
    return sorted(want, key=repr)


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_fold_terminal(spark, sizes):
    log = event_log()
    got = logs.fold_terminal(spark.createDataFrame(log, EVENTS).repartition(5), **sizes)
    assert rows_of(got) == shown_lines(log)


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_assemble_raw_output_in_parts(spark, sizes):
    log = event_log()
    got = logs.assemble_raw_output(spark.createDataFrame(log, EVENTS), segment_bytes=200, **sizes).collect()
    assert max(len(row.raw_output) for row in got) < 200 + 8
    assert max(row.part for row in got) > 15
    text = {}
    for row in sorted(got, key=lambda r: (r.job_id, r.part)):
        text[row.job_id] = text.get(row.job_id, "") + row.raw_output
    want = {}
    for job, _, name, data in sorted(log):
        if name == "outputLine":
            want[job] = want.get(job, "") + data + "\n"
        elif name == "carriageReturn":
            want[job] = want[job][:-1] + "\r"
    assert text == want


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_rows_stay_small_next_to_very_long_lines(spark, sizes):
    """Lines of 1 MB beside lines of 10 B, a limit of 100 kB: a row has less than the limit and one line."""
    lines = ["x" * 1_000_000 if seq % 100 == 50 else f"line {seq:05d}" for seq in range(400)]
    log = [(1, seq, "outputLine", line) for seq, line in enumerate(lines)]
    df = spark.createDataFrame(log, EVENTS).repartition(3)
    parts = logs.assemble_raw_output(df, segment_bytes=100_000, **sizes).orderBy("part").collect()
    assert "".join(row.raw_output for row in parts) == "".join(f"{line}\n" for line in lines)
    assert max(len(row.raw_output) for row in parts) < 1_100_001
    assert len(parts) >= 4
    nested = records.nest_events(df, segment_bytes=100_000, **sizes).orderBy("segment").collect()
    assert [e.data for row in nested for e in row.events] == lines
    assert max(sum(26 + len(e.data) for e in row.events) for row in nested) < 1_100_027


def test_property_in_parts(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (2,)], "id int")
    parts = spark.createDataFrame([(1, 0, "a"), (1, 4, "b"), (3, 0, None)], "job_id int, part bigint, raw_output string")
    got = lookups.property_parts(ids, parts, "raw_output")
    want = [(1, 0, "a", None), (1, 4, "b", None), (2, None, None, "not_found"), (3, None, None, "not_found")]
    assert rows_of(got) == sorted(want, key=repr)


def test_replay_of_a_long_log_to_many_subscribers(spark):
    log = [(0, seq, "outputLine", "x") for seq in range(500)] + [(1, 0, "status", "y")]
    asks = [(n, 0 if n % 3 else n % 2 + 1, n * 7 % 600) for n in range(200)] + [(999, 77, 0)]
    got = delivery.replay(
        spark.createDataFrame(asks, "subscriber bigint, job_id bigint, skip bigint"),
        spark.createDataFrame(log, EVENTS),
        chunk_events=64,
    )
    want = []
    for subscriber, job, skip in asks:
        events = [row for row in log if row[0] == job]
        want += [(subscriber, *row, True) for row in events if row[1] >= skip]
        if not events:
            want.append((subscriber, job, None, None, None, False))
    assert rows_of(got) == sorted(want, key=repr)


def plain_pairs(points, ranges):
    return sorted(
        (
            (r, p)
            for r, low, high in ranges
            for p, at in points
            if (low is None or at >= low) and (high is None or at < high)
        ),
        key=repr,
    )


def range_cases():
    draw = random.Random(11)
    points = [(n, 0 if n % 3 == 0 else draw.randrange(-5_000, 200_000)) for n in range(600)]
    ranges = [(0, None, None), (1, None, 0), (2, 0, 1), (3, 150_000, None), (4, 9, 9), (5, 20, 3)]
    for n in range(6, 60):
        low = draw.randrange(-9_000, 220_000)
        ranges.append((n, low, low + draw.choice([1, 50, 999, 1000, 64_000, 130_000])))
    return points, ranges


POINTS, RANGES = "id bigint, at bigint", "range_id int, from_ms bigint, to_ms bigint"


@pytest.mark.parametrize(
    "far", [[], [(-1, 2**60)], [(-1, 2**63 - 1), (-2, -(2**63))]], ids=["near", "far", "ends"]
)
@pytest.mark.parametrize("options", [{"base_bits": 8}, {"base_bits": 8, "ranges_per_part": 5}, {"base_bits": 2}, {}])
def test_points_within_ranges(spark, far, options):
    points, ranges = range_cases()
    points, ranges = points + far, [*ranges, (99, -(2**63), 2**63 - 1), (98, 2**63 - 1, None)]
    got = blocks.within_ranges(
        spark.createDataFrame(points, POINTS), "at", spark.createDataFrame(ranges, RANGES), **options
    )
    assert rows_of(got.select("range_id", "id")) == plain_pairs(points, ranges)


def test_blocks_of_a_range_grow_with_the_logarithm_of_its_span(spark):
    spans = [(1 << n) + 3 for n in range(0, 61, 4)]
    rows = spark.createDataFrame([(5, 5 + span) for span in spans], "first bigint, end bigint")
    found = rows.select((F.col("end") - F.col("first")).alias("span"), blocks.covering_blocks("first", "end", 0).alias("b"))
    for row in found.collect():
        covered = sorted((block << 3 * level, (block + 1) << 3 * level) for level, block in row.b)
        assert covered[0][0] == 5 and covered[-1][1] == 5 + row.span
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        assert len(covered) <= 14 * (row.span.bit_length() // 3 + 1)


def test_end_times_of_many_jobs_with_one_store_name(spark):
    jobs = spark.createDataFrame(
        [(f"j{n}", "hot" if n % 3 else f"s{n}") for n in range(900)], "id string, store_name string"
    )
    files = spark.createDataFrame([("hot", 5), ("s0", 7)], "store_name string, end_ms bigint")
    got = lookups.with_end_time(jobs, files).groupBy("end_ms").count()
    assert rows_of(got) == [(0, 299), (5, 600), (7, 1)]


def test_sampling_is_the_same_on_every_run(changes):
    chunks = [
        ordered.Chunks(df, ["store_name"], ["ts", "version"], **SMALL)
        .rows.select("version", ordered.CHUNK)
        for df in (changes, changes.repartition(3, "kind"))
    ]
    assert rows_of(chunks[0]) == rows_of(chunks[1])
