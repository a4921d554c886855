import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from joblens.functions import names
from joblens.operators import resolve

ID = "dQw4w9WgXcQ"

CASES = [
    # The usual shapes.
    (f"https://www.youtube.com/watch?v={ID}", "youtube", ID, None),
    (f"www.youtube.com/watch?v={ID}", "youtube", ID, None),
    (f"https://youtu.be/{ID}", "youtube", ID, None),
    (f"https://www.youtube.com/embed/{ID}", "youtube", ID, None),
    (ID, None, None, None),
    # Hosts and paths.
    ("https://youtube.com/watch?v=a", None, None, None),
    ("https://m.youtube.com/watch?v=a", None, None, None),
    ("https://WWW.YouTube.com:443/Watch?v=Ab", "youtube", "Ab", None),
    ("ftp://user@www.youtube.com/EMBED//x/y", "youtube", "x", None),
    ("https://www.youtube.com/embed", None, None, None),
    ("https://www.youtube.com/channel/x", None, None, None),
    ("https://www.youtube.com/embed/a%2Fb", "youtube", "a", None),
    ("https://youtu.be/a+b", "youtube", "a+b", None),
    ("https://youtu.be/%C3%A9", "youtube", "é", None),
    ("https://www.youtube.com/", None, None, "path.missing"),
    ("https://youtu.be", None, None, "path.missing"),
    ("https://youtu.be//", None, None, "path.missing"),
    ("https://foo_bar/x", None, None, "host.missing"),
    ("http://a b/", None, None, None),
    ("a://", None, None, None),
    # Queries.
    ("https://www.youtube.com/watch?a=1&v=p%3Dq=r", "youtube", "p=q=r", None),
    ("https://www.youtube.com/watch?a=1", None, None, None),
    ("https://www.youtube.com/watch?v=", "youtube", "", None),
    ("https://www.youtube.com/watch?av=1&v=2#v=3", "youtube", "2", None),
    ("https://www.youtube.com/watch?v=1%262", None, None, "query.malformed"),
    ("https://www.youtube.com/watch?v=1%26w=2", "youtube", "1", None),
    ("https://www.youtube.com/watch", None, None, "query.missing"),
    ("https://www.youtube.com/watch?", None, None, "query.malformed"),
    ("https://www.youtube.com/watch?v", None, None, "query.malformed"),
    ("https://www.youtube.com/watch?v=1&", None, None, "query.malformed"),
    ("https://www.youtube.com/watch?v=1&v=2", None, None, "query.duplicate"),
    ("https://www.youtube.com/watch?a=1&v=1&a=2", None, None, "query.duplicate"),
    ("https://www.youtube.com/embed/x?v&v", "youtube", "x", None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(case[0],) for case in CASES], "video string")


def test_match_videos(cases):
    got = resolve.match_videos(cases).select("video", "provider", "id", "error_code")
    assert rows_of(got) == sorted(CASES, key=repr)


def test_dispatch_falls_back_to_the_text(cases):
    resolved, bad = resolve.dispatch_providers(cases)
    want = [(v, p or "unknown", i if p else v) for v, p, i, e in CASES if e is None]
    assert rows_of(resolved.select("video", "provider", "id")) == sorted(want, key=repr)
    assert rows_of(bad.select("video", "error_code")) == sorted(
        ((v, e) for v, _, _, e in CASES if e), key=repr
    )


def test_first_rule_with_a_result_wins(spark):
    def clips(url):
        return resolve.Match(
            "clips",
            F.when(url.host == "clips.example", F.try_element_at(url.path_parts, F.lit(1))),
            F.when(url.host == "down.example", "host.down"),
        )

    df = spark.createDataFrame(
        [("clips.example/7",), ("down.example/7",), ("youtu.be/8",), ("other.example/9",)],
        "video string",
    )
    got = resolve.match_videos(df, [clips, resolve.youtube_rule]).select(
        "video", "provider", "id", "error_code"
    )
    assert rows_of(got) == [
        ("clips.example/7", "clips", "7", None),
        ("down.example/7", None, None, "host.down"),
        ("other.example/9", None, None, None),
        ("youtu.be/8", "youtube", "8", None),
    ]


def test_rules_are_evaluated_once_in_generated_code(cases):
    resolved, _ = resolve.dispatch_providers(cases)
    named = resolve.with_store_name(resolved).where("store_name <> 'x'")
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1
    assert "Python" not in plan


def test_validate_submissions(spark):
    df = spark.createDataFrame(
        [(None, None), ("{}", None), ("{}", ""), ("{}", "  "), ("{}", "x")],
        "body string, video string",
    )
    valid, rejected = resolve.validate_submissions(df, body="body")
    assert rows_of(valid) == [("{}", "  "), ("{}", "x")]
    assert rows_of(rejected.select("body", "error_code")) == [
        ("{}", "video.not.provided"),
        ("{}", "video.not.provided"),
        (None, "body.not.provided"),
    ]
    assert resolve.validate_submissions(df, body="body", trim_blank=True)[0].count() == 1


def test_query_params(spark):
    df = spark.createDataFrame(
        [(1, "https://h/p?a=1&b=x=y&c="), (2, "https://h/p?a"), (3, "https://h/p"), (4, "h/?a=1&a=2"),
         (5, "http://a b/")],
        "row_id int, url string",
    )
    pairs, bad = resolve.explode_query_params(df, "row_id")
    assert rows_of(pairs) == [(1, "a", "1"), (1, "b", "x=y"), (1, "c", "")]
    assert rows_of(bad) == [(2, "query.malformed"), (3, "query.missing"), (4, "query.duplicate")]


def test_store_name_replaces_unsafe_characters(spark):
    df = spark.createDataFrame(
        [("unknown", 'a/b\\c?d%e*f:g|h"i<j>k'), ("p", None)], "provider string, id string"
    )
    got = [row.store_name for row in resolve.with_store_name(df).collect()]
    assert got == ["unknown-a_b_c_d_e_f_g_h_i_j_k", None]


def test_strip_id_and_disposition(spark):
    df = spark.createDataFrame(
        [("a-x.b-x.mp3", "x"), ("a-x+.mp3", "x+"), ("é a*~.mp3", "n"), ('q".mp3', "n")],
        "name string, id string",
    )
    got = df.select(
        names.strip_id(F.col("name"), F.col("id")).alias("s"),
        names.content_disposition(F.col("name")).alias("d"),
    ).collect()
    assert [row.s for row in got] == ["a.b.mp3", "a.mp3", "é a*~.mp3", 'q".mp3']
    assert got[2].d == (
        "attachment; filename=\"%C3%A9%20a*%7E.mp3\"; filename*=utf8''%C3%A9%20a*%7E.mp3"
    )
    assert got[3].d == 'attachment; filename="q".mp3"'


def test_build_completed_takes_the_last_success(spark):
    df = spark.createDataFrame(
        [("s", "v", "old-v.mp3", "SUCCESSFUL", 1), ("s", "v", "new-v.mp3", "SUCCESSFUL", 2),
         ("s", "v", None, "FAILED", 3)],
        "store_name string, video_id string, result_name string, status string, version int",
    )
    assert rows_of(resolve.build_completed(df)) == [("s", "new.mp3", 2)]
