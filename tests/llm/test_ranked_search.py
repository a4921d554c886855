"""Ranked search against a plain version that scores every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joblens.llm import ranked_search as search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, file string, place string, query string, score string"


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(docs, items, n=10):
    counts = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    sized = [(doc_id, c, c.total()) for doc_id, c in counts if c]
    documents, terms = len(sized), sum(size for _, _, size in sized)
    df = Counter(t for _, c, _ in sized for t in c)
    rows = []
    for item_id, text in items:
        found = []
        for doc_id, c, size in sized:
            m = 100 - 90 + (90 * size * documents) // terms
            score = 0
            for t in set(plain_terms(text)) & set(c):
                weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += weight * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        found.sort()
        rows += [
            (item_id, k + 1, None if null else doc_id, -score)
            for k, (score, null, doc_id) in enumerate(found[:n])
        ]
    return sorted(rows, key=repr)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "ba ke li mo nu ra".split() for b in range(70)]
    odds = 1 / np.arange(1, len(words) + 1)
    draw = lambda k: " ".join(rng.choice(words, k, p=odds / odds.sum()))
    texts = [draw(int(k)) for k in rng.integers(1, 90, 400)]
    items = [draw(int(k)) for k in rng.integers(1, 25, 30)]
    planted = [f"{draw(20)} {item} {draw(10)}" for item in items[:10] for _ in range(3)]
    odd = [None, "", " .,;\n", "Ba0 BA0 ba0", "ÄÖ straße ÄÖ", "naïve 日本 日本", "x" * 5000]
    long_texts = [draw(30_000), " ".join(["ba0"] * 3000) + " ke1"]
    texts = texts + planted + odd + long_texts + [texts[7]] * 25 + [items[0]] * 14
    docs = [(i if i % 11 else i // 2, t) for i, t in enumerate(texts)] + [(None, items[0])] * 2
    return docs, [*enumerate(items), (5, items[5]), (None, "ba0 ke1"), (90, None), (91, "?!"), (92, "unheard")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    return (
        spark.createDataFrame([(*row, "c", "c", "c", "c") for row in docs], SCHEMA).repartition(6),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("options", [{}, {"first": 2}, {"first": 3, "block_items": 7}, {"n": 3, "first": 1}])
def test_search_equals_plain_version(tables, options):
    found = search.search(*tables, **options).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search(*corpus(), options.get("n", 10))


def test_few_documents_are_scored(spark, tables):
    docs, items = tables
    docs = search.saved(docs, "searched-rows")
    index = search.saved(search.build_index(docs), "sketch-index")
    total = search.corpus_of(index)
    (queries,) = search.query_blocks(items)
    weight = search.weights(index, queries, total)
    bounds = spark.sparkContext.broadcast(search.Bounds(queries, weight, total))
    best = plain_search(*corpus())
    threshold = np.array(
        [min([r[3] for r in best if r[0] == i and r[1] == 10], default=1) for i in queries.rows], np.float32
    )
    pairs = search.reaching(index, bounds, threshold * np.float32(1 - 2.0**-20)).collect()
    assert sum(len(row.queries) for row in pairs) < 0.3 * docs.count() * len(queries.rows)


def test_empty_tables(spark, tables):
    docs, items = tables
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(no_docs, items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_those_of_the_expression(text):
    assert [t.decode() for t in search.terms_of(text)] == plain_terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 700), max_size=40), min_size=1, max_size=5))
def test_bounds_are_never_below_scores(counts):
    counters = [Counter({f"w{t}".encode(): n for t, n in c.items()}) for c in counts]
    total = search.Corpus(9, 4000)
    terms = [f"w{t}".encode() for t in range(60)]
    queries = search.Queries(["a", "b"], terms, np.repeat([0, 1], [60, 20]), np.array([*range(60), *range(20)]))
    weight = np.arange(60) * 97
    bounds, scorer = search.Bounds(queries, weight, total), search.Scorer(queries, weight, total)
    for c, (width, packed) in zip(counters, search.sketches(counters)):
        if not c:
            assert (width, packed) == (0, b"")
            continue
        n = np.array([c.total()])
        found = bounds.of(n, search.unpacked(width, [packed]))[0]
        parts = scorer.parts(" ".join(t.decode() for t in c.elements()))
        assert all(found[q] >= scorer.score(parts, q) for q in (0, 1))
