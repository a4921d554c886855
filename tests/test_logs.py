import random

import pytest
from conftest import rows_of

from joblens.operators import logs
from joblens.sources import records


def split_by_hand(data: bytes):
    events, line = [], bytearray()
    for byte in data:
        if byte in b"\r\n":
            events.append(("outputLine", line.decode("utf-8", "replace")))
            line.clear()
            if byte == 13:
                events.append(("carriageReturn", ""))
        else:
            line.append(byte)
    if line:
        events.append(("outputLine", line.decode("utf-8", "replace")))
    return events


TEXTS = ["", "a\nb", "a\rb\n", "a\r\n", "a\r", "\r\r", "\n", "\n\n", "é\r\nü", "no end", "\r\na"]


def test_split_log_events(spark):
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice("ab\r\n") for _ in range(draw.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id int, log string")
    want = [
        (job, seq, *event)
        for job, text in enumerate(texts)
        for seq, event in enumerate(split_by_hand(text.encode()))
    ]
    assert rows_of(logs.split_log_events(df)) == sorted(want, key=repr)


def test_split_binary_log_replaces_malformed_bytes(spark):
    raw = b"ok\xff!\r\xc3\xa9\n\xe2\x82"
    df = spark.createDataFrame([(1, bytearray(raw))], "job_id int, log binary")
    got = [tuple(r)[2:] for r in logs.split_log_events(df).orderBy("seq").collect()]
    assert got == split_by_hand(raw)


@pytest.mark.parametrize(
    "text,shown", [("a\rb\n", ["b"]), ("a\r\n", [""]), ("a\r", ["a"]), ("a\nb", ["a", "b"]), ("", [])]
)
def test_fold(spark, text, shown):
    df = spark.createDataFrame([(1, text)], "job_id int, log string")
    folded = logs.fold_terminal(logs.split_log_events(df)).orderBy("seq").collect()
    assert [row.data for row in folded] == shown


def test_raw_output_is_the_log_with_a_last_terminator(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "job_id int, log string")
    got = logs.assemble_raw_output(logs.split_log_events(df))
    want = [
        (job, 0, text if text.endswith(("\r", "\n")) else text + "\n")
        for job, text in enumerate(TEXTS)
        if text
    ]
    assert rows_of(got) == sorted(want, key=repr)


def test_nest_and_unnest(spark):
    rows = [(1, seq, "outputLine", None if seq == 3 else str(seq)) for seq in range(10)]
    df = spark.createDataFrame(rows, "job_id int, seq bigint, name string, data string")
    nested = records.nest_events(df.orderBy("data"), segment_bytes=107)
    sizes = [(r.segment, [e.seq for e in r.events]) for r in nested.orderBy("segment").collect()]
    assert sizes == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]
    assert rows_of(records.unnest_events(nested)) == rows


def test_nest_keeps_the_order_of_events_without_an_id(spark):
    rows = [(1, None if at % 3 else at, f"e{9 - at}", str(at), at) for at in range(10)]
    df = spark.createDataFrame(rows, "job_id int, seq bigint, name string, data string, at bigint")
    nested = records.nest_events(df.orderBy("name"), segment_bytes=76, position="at")
    got = [(r.segment, [(e.seq, e.data) for e in r.events]) for r in nested.orderBy("segment").collect()]
    ids = [None if at % 3 else at for at in range(10)]
    assert got == [(n, [(ids[at], str(at)) for at in range(4 * n, min(4 * n + 4, 10))]) for n in range(3)]
    assert rows_of(records.unnest_events(nested)) == sorted((r[:4] for r in rows), key=repr)
    with pytest.raises(Exception, match="an event has no seq"):
        records.nest_events(df).collect()


def test_first_status_is_created(spark):
    df = spark.createDataFrame(
        [("j", "CREATED", 1), ("j", "CONVERTING", 2), ("j", "CONVERTING", 3), ("j", "CREATED", 4)],
        "job_id string, status string, version int",
    )
    got = logs.status_transitions(df, ["version"])
    assert rows_of(got) == [("j", "CONVERTING", 2), ("j", "CREATED", 4)]
