"""Token alignment against a plain version: one text at a time, ends looked up in sets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from joblens.llm import alignment
from joblens.llm.common import saved

PATH_A, PATH_B = alignment.tokenizer_paths()
SPACES = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "'", "'s", ".", "1", "23"]


def letters_of_bytes() -> dict[str, int]:
    """The byte of each letter that byte-level tokens are written in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def plain_tokens():
    whole = Tokenizer.from_file(PATH_A)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = letters_of_bytes()

    def tokens(text: str):
        a = whole.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(model.id_to_piece(i)[3:5], 16)])
            if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        given_text = (" " + text).encode()
        if not text or b"".join(bytes_a) != given_text or b"".join(bytes_b) != given_text:
            return [], [], [], []
        return a, b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()

    return tokens


def plain_groups(a, b, ends_a, ends_b):
    common = set(ends_a) & set(ends_b)
    groups, at = [], [0, 0]
    for end in sorted(common):
        stop = [ends_a.index(end) + 1, ends_b.index(end) + 1]
        groups.append((a[at[0] : stop[0]], b[at[1] : stop[1]]))
        at = stop
    return groups


def written(groups) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain_rows(texts, tokens):
    found = [(*tokens(t or ""),) for t in texts]
    groups = [plain_groups(*each) for each in found]
    counts = Counter((a[-1], b[-1]) for each in groups for a, b in each)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for (a, b, _, _), own in zip(found, groups):
        links = [(x[-1], y[-1]) for x, y in own]
        rows.append(
            (
                len(a),
                len(b),
                len(own),
                len(links),
                sum(counts[p] == best[p[1]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(written(own).encode()).hexdigest() if own else "",
            )
        )
    return rows


TEXTS = [
    None, "", " ", "a", "  two  spaces and a tail  ", "line\n next\n\n  more\t\ttabs \r\n end",
    "<|endoftext|> inside <s> </s> <unk> <0x41>", "a ▁ b", "▁", "naïve façade — “quotes” … ½ ﬁ É",
    "日本語のテキスト 中文 テキスト", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 family", "nul \x00 byte \x7f",
    "it's we'll 'tis don 't", "1234567890 3.14159 1,000,000", "x" * 4000, " " * 700, "word " * 3000,
    "The quick brown fox jumps over the lazy dog. " * 40, "repeat", "repeat", "repeat",
]


def test_rows_equal_plain_version(spark, plain_tokens):
    rows = [(i // 2, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string").repartition(5)
    aligned = saved(alignment.aligned_texts(docs, PATH_A, PATH_B, batch_chars=3000), "aligned")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.with_link_counts(aligned).select(*names).collect()
    plain = [(r[0], *p) for r, p in zip(rows, plain_rows([r[1] for r in rows], plain_tokens))]
    assert sorted(map(tuple, found), key=repr) == sorted(plain, key=repr)


def test_table_of_linked_ids(spark, plain_tokens):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    aligned = saved(alignment.aligned_texts(docs, PATH_A, PATH_B), "aligned")
    found = alignment.alignment_table(alignment.batch_pairs(aligned)).collect()
    counts = Counter(
        (a[-1], b[-1]) for t in TEXTS for a, b in plain_groups(*plain_tokens(t or ""))
    )
    assert {(r.a_id, r.b_id): r["count"] for r in found} == counts


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = saved(alignment.aligned_texts(docs, PATH_A, PATH_B), "aligned")
    assert alignment.with_link_counts(aligned).collect() == []


def test_repeated_rows_in_many_batches_share_counts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    aligned = saved(
        alignment.aligned_texts(docs.repartition(7), PATH_A, PATH_B, batch_chars=100), "aligned"
    )
    rows = alignment.with_link_counts(aligned).collect()
    assert len(rows) == 300
    assert {(r.n_best, r.count_sum) for r in rows} == {(rows[0].n_links, 300 * rows[0].n_links)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SPACES), st.text(max_size=8)), max_size=30))
def test_word_by_word_ids_are_those_of_the_text(plain_tokens, parts):
    text = "".join(parts)
    a, b, _, _ = plain_tokens(text)
    found = alignment.token_arrays([text, "next text"], alignment.byte_level(PATH_A), alignment.pieces(PATH_B))
    for own, tokens in zip((a, b), found):
        assert tokens.ids[: tokens.first[1]].tolist() == own


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40)),
        min_size=1,
        max_size=6,
    ),
    st.integers(1, 9),
    st.integers(1, 5),
)
def test_runs_hold_every_common_end(texts, lane, window):
    ends, firsts, base = ([], []), ([0], [0]), 0
    for a, b in texts:
        for k, own in enumerate((a, b)):
            ends[k].extend(base + e for e in sorted(own | {61}))
            firsts[k].append(len(ends[k]))
        base += 61
    ends_a, ends_b = map(np.array, ends)
    i, j, n = alignment.aligned_runs(ends_a, ends_b, *map(np.array, firsts), lane, window)
    found = ends_a[alignment.ranges(i, n)]
    assert found.tolist() == sorted(set(ends[0]) & set(ends[1]))
    assert found.tolist() == ends_b[alignment.ranges(j, n)].tolist()
