"""Personal data: base spans against plain expressions, the field against sums over all segmentations."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joblens.llm import private_spans as spans
from joblens.llm.common import saved

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, form in FORMS.items():
        for match in re.finditer(form, text):
            part = match.group()
            digits = re.sub("[^0-9]", "", part)
            checksum = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in part.split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and checksum % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if fits():
                found.append((match.start(), list(FORMS).index(kind) + 1, match.end()))
    return sorted(found)


def written(found):
    return ",".join(f"{spans.KINDS[k - 1]}:{s}:{e}" for s, k, e in sorted(found))


CARDS = ["4111111111111111", "5500-0000-0000-0004", "3400 000000 00009", "6011000990139424"]
PIECES = st.sampled_from(
    [*CARDS, "4111111111111112", "a.b@c.de", "@", "x@y", "x@y.z", "x_y@z.w-v.u", "%+@a.b.c", "10.0.0.1", "1.2.3.4.5",
     "999.1.1.1", "007.1.2.3", "+1 (555) 010-4477", "+44 20 7946 0018", "+1", "+", "(", ")", " ", "-", ".", "..",
     "12", "7", "ä", "word", "\n", "2024", "1234567890123", "\U0001f600", "٣"]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(PIECES, st.sampled_from([" ", ", ", ""])), max_size=20).map("".join))
def test_base_spans_are_those_of_the_expressions(text):
    found = spans.windows(text)
    assert sorted(s for w in found for s in w.base) == plain_spans(text)
    for w in found:
        assert text[w.start : w.start + len(w.text)] == w.text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 200_000):
        spans.windows(text)


def samples():
    rng = np.random.default_rng(3)
    number = lambda *sizes: [str(rng.integers(10 ** (n - 1), 10**n)) for n in sizes]
    texts = []
    for _ in range(80):
        card = number(15)[0]
        card += next(d for d in "0123456789" if spans.luhn(card + d))
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        area, first, last = number(3, 3, 4)
        texts += [
            f"pay with {card} today", f"order {wrong} came", f"call +1 ({area}) {first}-{last} now",
            f"host {'.'.join(map(str, rng.integers(1, 255, 4)))} is up", f"write to n{area}.x@mail{last}.example.com please",
            f"version {area[0]}.{first[0]} of {last}", f"page {last}, line {first}",
        ]
    return texts


MERGED = [
    ("cards 4111111111111111 6011000990139424 end", [(6, 3, 22), (23, 3, 39)]),
    ("call +1 (555) 210-4477 10.20.30.40 now", [(5, 4, 22)]),
    ("call +1 (555) 210-4477 4111111111111111 now", [(5, 4, 22), (23, 3, 39)]),
]
CLEAN = ["order 4111111111111112 and 6011000990139425", "in 1999-2004, 12 of 340 (7.5%)", "", "2.0. 3.14.15", "@ home @ work"]


@pytest.fixture(scope="module")
def field():
    return spans.train([w for t in samples() for w in spans.windows(t)])


@pytest.mark.parametrize("text,added", MERGED)
def test_merged_matches_are_parted(field, text, added):
    (window,) = spans.windows(text)
    base = plain_spans(text)
    assert [s for s in spans.new_spans(field, window)] == [s for s in added if s not in base]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(field, text):
    assert [s for w in spans.windows(text) for s in spans.new_spans(field, w)] == []


def test_field_finds_unseen_base_spans(field):
    texts = [t.replace("1", "7") for t in samples()]
    pairs = [(w, spans.best_segments(field, w)) for t in texts for w in spans.windows(t)]
    assert np.mean([w.base == found for w, found in pairs]) > 0.99


def segmentations(found, size):
    """All ways to cut 0..size into the given segments."""
    by_start = {}
    for k, e in enumerate(found):
        by_start.setdefault(e.start, []).append((k, e))

    def ways(at):
        if at == size:
            yield []
        for k, e in by_start.get(at, []):
            for rest in ways(e.stop):
                yield [k, *rest]

    return ways(0)


def score_of(ex, way, weights, pairs):
    total, before = 0.0, 0
    for k in way:
        e = ex.edges[k]
        total += weights[ex.features[k]].sum() + (spans.PRIOR if e.label else 0) + pairs[before, e.label]
        before = e.label
    return total


@pytest.mark.parametrize("text", ["+1 555 0100 22", "a.b@c.de", "1.2.3.4", "x 4111111111111111"])
def test_likelihood_gradient_and_best_equal_sums_over_all(text):
    (window,) = spans.windows(text)
    places = {}
    ex = spans.example(window, places)
    rng = np.random.default_rng(1)
    weights, pairs = rng.normal(size=len(places)), rng.normal(size=(5, 5))
    ways = list(segmentations(ex.edges, ex.size))
    scores = np.array([score_of(ex, way, weights, pairs) for way in ways])
    share = np.exp(scores - np.logaddexp.reduce(scores))
    likelihood, (numbers, values), pair_gradient = spans.gradient(ex, weights, pairs)
    assert likelihood == pytest.approx(np.log(share[ways.index(ex.gold)]))
    expected, expected_pairs = np.zeros(len(places)), np.zeros((5, 5))
    for way, p in [*zip(ways, -share), (ex.gold, 1.0)]:
        before = 0
        for k in way:
            np.add.at(expected, ex.features[k], p)
            expected_pairs[before, ex.edges[k].label] += p
            before = ex.edges[k].label
    assert np.bincount(numbers, values, len(places)) == pytest.approx(expected, abs=1e-9)
    assert pair_gradient == pytest.approx(expected_pairs, abs=1e-9)
    best = ways[int(scores.argmax())]
    _, bounds = spans.edges(window)
    wanted = [
        (bounds[e.start], e.label, bounds[e.stop]) for e in (ex.edges[k] for k in best) if e.label
    ]
    found = spans.best_segments(spans.Field(places, weights, pairs), window._replace(start=0))
    assert found == wanted


def test_query_over_awkward_rows(spark):
    texts = [None, "", "ä \U0001f600 x@y.zz", "x@y.zz", "x@y.zz", "no data", "z " * 60_000 + "10.0.0.1", *samples()]
    texts += [text for text, _ in MERGED] + CLEAN
    rows = [(i // 2, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "4111111111111111", "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, windows string").repartition(4)
    found = saved(spans.windowed(docs), "windows")
    field = spans.train(spans.sampled(found))
    result = spans.with_digests(spans.find_spans(found, field)).collect()
    plain = [(r[0], written(plain_spans(r[1] or ""))) for r in rows]
    digests = [(d, hashlib.sha256(s.encode()).hexdigest()) for d, s in plain]
    assert sorted([(r.doc_id, r.base_sha256) for r in result], key=repr) == sorted(digests, key=repr)
    counts = sum(s.count("card:") for _, s in plain)
    assert sum(r.n_card for r in result) == counts
    for text, added in MERGED:
        wanted = written({*plain_spans(text), *added})
        assert wanted in {r.spans for r in result}
    assert sum(r.n_added for r in result) == sum(len(set(a) - set(plain_spans(t))) for t, a in MERGED)


def test_empty_table_and_no_examples(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = saved(spans.windowed(docs), "windows")
    field = spans.train(spans.sampled(found))
    assert spans.with_digests(spans.find_spans(found, field)).collect() == []
    assert spans.new_spans(field, *spans.windows("call +1 555 0100 4477 4111111111111111")) == []


def test_sample_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame(list(enumerate(samples())), "doc_id long, text string")
    found = spans.windowed(docs)
    first = spans.sampled(found, 20)
    assert first == spans.sampled(found.orderBy(F.desc("doc_id")).repartition(3), 20)
    assert len(first) <= 5 * 20
