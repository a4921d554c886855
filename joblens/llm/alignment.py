"""Token alignment between two tokenizers by diagonal run skipping.

Both tokenizers cut the same bytes (a space and the text), so each gives a rising array of byte
ends. Where the arrays agree at an index shift, they mostly go on agreeing: windows of 8, 16, 32,
... ends are compared at that shift until one differs, and the whole stretch is jumped. At the
difference a step-by-step merge finds the next common end, which sets the new shift. Common ends cut
the tokens into groups, and the last tokens of a group are linked.

A task takes texts in batches of bounded size. All texts of a batch are aligned in lockstep, long
ones in several lanes that start at common ends. Each batch names its distinct linked pairs once;
Spark sums these over the corpus and sends the sums back to the batches, so a pair that every
text holds costs one row a batch.

A word is encoded once per batch: neither vocabulary has tokens across a single space between two
characters that are not white space, so the ids of a text are those of its words.

Defined results: a text that is null or empty, or that a tokenizer does not give back byte by byte,
has no tokens, zeros and an empty groups column; repeated rows count as often as they come, equal or
null doc_ids are rows of their own; ties for the highest count of a B id are all best; an empty
table gives an empty result; extra columns are ignored; a text of any length is aligned whole.
"""

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import saved, table

#: A batch ends with the text that brings it to this many characters.
BATCH_CHARS = 8_000_000
#: Lanes of a long text have about this many A tokens.
LANE = 256
#: The first window of a probe.
WINDOW = 8
#: Words that are encoded in one call.
WORDS_PER_CALL = 4096

#: Single spaces between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary(NamedTuple):
    """`encode` takes a text and gives the ids of a space and that text."""

    encode: Callable[[str], list[int]]
    tokens: list[bytes]
    lengths: np.ndarray


def _vocabulary(encode, tokens: list[bytes]) -> Vocabulary:
    return Vocabulary(encode, tokens, np.array([len(t) for t in tokens], np.int64))


@functools.cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level tokenizer file; its names of special tokens are plain text.

    The rank file beside it holds the same vocabulary and is faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    with open(path) as file:
        size = 1 + max(json.load(file)["model"]["vocab"].values())
    tokens = [b""] * size
    for token, number in ranks.items():
        tokens[number] = token
    return _vocabulary(lambda text: plain.encode_ordinary(" " + text), tokens)


@functools.cache
def pieces(path: str) -> Vocabulary:
    """A SentencePiece model, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(number: int) -> bytes:
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    return _vocabulary(model.encode, [token(i) for i in range(model.get_piece_size())])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoded(NamedTuple):
    """ids of words one after the other; those of word w are ids[first[w]:first[w + 1]]."""

    ids: np.ndarray
    first: np.ndarray
    whole: np.ndarray  # whether a word's tokens give back its bytes


def _encode_one(words: list[str], vocabulary: Vocabulary) -> tuple[list[int], list[int], list[bool]]:
    ids, counts, whole = [], [], []
    for word in words:
        own = list(vocabulary.encode(word))
        ids += own
        counts.append(len(own))
        whole.append(b"".join([vocabulary.tokens[i] for i in own]) == b" " + word.encode())
    return ids, counts, whole


def encode_words(words: list[str], vocabulary: Vocabulary) -> Encoded:
    """Words joined by spaces are encoded together and cut at their byte ends."""
    ids, counts, whole = [], [], []
    for at in range(0, len(words), WORDS_PER_CALL):
        part = words[at : at + WORDS_PER_CALL]
        text = " ".join(part)
        own = vocabulary.encode(text)
        if b"".join([vocabulary.tokens[i] for i in own]) == b" " + text.encode():
            ends = np.cumsum(vocabulary.lengths[own])
            stops = np.cumsum([1 + len(word.encode()) for word in part])
            last = np.searchsorted(ends, stops)
            if (ends[last] == stops).all():
                ids.append(np.array(own, np.int64))
                counts.append(np.diff(last, prepend=-1))
                whole.append(np.ones(len(part), bool))
                continue
        own, count, same = _encode_one(part, vocabulary)
        ids.append(np.array(own, np.int64))
        counts.append(np.array(count, np.int64))
        whole.append(np.array(same, bool))
    if not words:
        return Encoded(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return Encoded(np.concatenate(ids), first, np.concatenate(whole))


class Tokens(NamedTuple):
    """The ids of several texts one after the other; those of text t are ids[first[t]:first[t + 1]]."""

    ids: np.ndarray
    first: np.ndarray


def token_arrays(texts: list[str], *vocabularies: Vocabulary) -> list[Tokens]:
    """Per vocabulary the tokens of the texts; none for texts that some vocabulary changes."""
    number: dict[str, int] = {}
    used = [[number.setdefault(w, len(number)) for w in CUT.split(t)] if t else [] for t in texts]
    encoded = [encode_words(list(number), v) for v in vocabularies]
    whole = np.logical_and.reduce([e.whole for e in encoded])
    sizes = np.array([len(words) for words in used], np.int64)
    words = np.fromiter((w for each in used for w in each), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    if not whole.all():
        changed = np.unique(text_of[~whole[words]])
        # word by word they differ; compared as a whole before they are given up
        rest = [t for t in changed if all(_same(texts[t], v) for v in vocabularies)]
        if rest:
            return [_encode_whole(texts, set(changed) - set(rest), v) for v in vocabularies]
        keep = ~np.isin(text_of, changed)
        words, text_of = words[keep], text_of[keep]
    found = []
    for e in encoded:
        lengths = np.diff(e.first)[words]
        per_text = np.bincount(text_of, lengths, len(texts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(per_text)])
        found.append(Tokens(e.ids[ranges(e.first[words], lengths)], first))
    return found


def _same(text: str, vocabulary: Vocabulary) -> bool:
    return b"".join([vocabulary.tokens[i] for i in vocabulary.encode(text)]) == b" " + text.encode()


def _encode_whole(texts: list[str], without: set[int], vocabulary: Vocabulary) -> Tokens:
    each = [
        np.array(vocabulary.encode(t) if t and i not in without else [], np.int64)
        for i, t in enumerate(texts)
    ]
    return Tokens(np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]))


def _next_common(ends_a, ends_b, at_a, at_b) -> None:
    """Moves each (at_a, at_b) to the first common end at or after both, in place."""
    open_lanes = np.flatnonzero(ends_a[at_a] != ends_b[at_b])
    while open_lanes.size:
        behind = ends_a[at_a[open_lanes]] < ends_b[at_b[open_lanes]]
        at_a[open_lanes] += behind
        at_b[open_lanes] += ~behind
        differ = ends_a[at_a[open_lanes]] != ends_b[at_b[open_lanes]]
        open_lanes = open_lanes[differ]


def _lanes(ends_a, ends_b, first_a, first_b, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes start: at each text, and in a long one at common ends about `lane` apart."""
    sizes = np.diff(first_a)
    inner = np.maximum((sizes - 1) // lane, 0)
    at_a = np.repeat(first_a[:-1], inner) + lane * (ranges(np.zeros_like(inner), inner) + 1) - 1
    at_b = np.searchsorted(ends_b, ends_a[at_a])
    _next_common(ends_a, ends_b, at_a, at_b)
    starts = np.unique(np.concatenate([first_a[:-1][sizes > 0], at_a + 1]))
    starts = starts[starts < len(ends_a)]
    before = np.where(starts > 0, ends_a[starts - 1], 0)
    return starts, np.where(starts > 0, np.searchsorted(ends_b, before) + 1, 0)


def aligned_runs(
    ends_a: np.ndarray, ends_b: np.ndarray, first_a, first_b, lane: int = LANE, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n): stretches in which ends_a[i + k] = ends_b[j + k] for k < n, in order.

    The ends rise over all texts; text t has ends_a[first_a[t]:first_a[t + 1]], its last end is
    common to both sides. The last index of each side takes part like every other."""
    if not len(ends_a):
        return (np.zeros(0, np.int64),) * 3
    at_a, at_b = _lanes(ends_a, ends_b, first_a, first_b, lane)
    stop_a = np.append(at_a[1:], len(ends_a))
    found = []
    while at_a.size:
        # probe: windows that double while they agree at the lane's shift
        run, width = np.zeros(len(at_a), np.int64), window
        probing = np.arange(len(at_a))
        while probing.size:
            ahead = run[probing, None] + np.arange(width)
            a = np.minimum(at_a[probing, None] + ahead, len(ends_a) - 1)
            b = np.minimum(at_b[probing, None] + ahead, len(ends_b) - 1)
            differ = ends_a[a] != ends_b[b]
            some = differ.any(1)
            run[probing] += np.where(some, differ.argmax(1), width)
            probing = probing[~some & (at_a + run < stop_a)[probing]]
            width *= 2
        run = np.minimum(run, stop_a - at_a)
        found.append((at_a[run > 0], at_b[run > 0], run[run > 0]))
        at_a, at_b = at_a + run, at_b + run
        left = at_a < stop_a
        at_a, at_b, stop_a = at_a[left], at_b[left], stop_a[left]
        _next_common(ends_a, ends_b, at_a, at_b)
    i, j, n = (np.concatenate(parts) for parts in zip(*found))
    order = np.argsort(i)
    return i[order], j[order], n[order]


class Aligned(NamedTuple):
    """Groups of several texts: last_a[g], last_b[g] are the indices of the last tokens of group g,
    and text t has the groups first[t]:first[t + 1]."""

    last_a: np.ndarray
    last_b: np.ndarray
    first: np.ndarray


def align(a: Tokens, b: Tokens, vocabulary_a: Vocabulary, vocabulary_b: Vocabulary) -> Aligned:
    ends_a, ends_b = np.cumsum(vocabulary_a.lengths[a.ids]), np.cumsum(vocabulary_b.lengths[b.ids])
    i, j, n = aligned_runs(ends_a, ends_b, a.first, b.first)
    last_a, last_b = ranges(i, n), ranges(j, n)
    return Aligned(last_a, last_b, np.searchsorted(last_a, a.first))


def _written(ids_a, ids_b, groups: Aligned, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of all groups, `a1,a2|b1;a3|b2,b3;`, as bytes, and the place of each group's end in it."""
    last_a, last_b = groups.last_a, groups.last_b
    names = []
    for size, inner, final in ((size_a, ",", "|"), (size_b, ",", ";")):
        names.append(np.array([f"{i}{c}" for i in range(size) for c in (inner, final)], "S"))
    width = max(each.dtype.itemsize for each in names)
    cells = np.empty(len(ids_a) + len(ids_b), f"S{width}")
    for ids, last, other, each, own in (
        (ids_a, last_a, np.concatenate([[-1], last_b[:-1]]), names[0], 0),
        (ids_b, last_b, last_a, names[1], 1),
    ):
        ends = np.zeros(len(ids), np.int64)
        ends[last] = 1
        group = np.cumsum(ends) - ends
        cells[np.arange(len(ids)) + other[group] + 1] = each[2 * ids + ends]
    letters = cells.view(np.uint8)
    used = letters != 0
    stops = np.cumsum(used.reshape(-1, width).sum(1))
    return letters[used], stops[last_a + last_b + 1]


def group_digests(a: Tokens, b: Tokens, groups: Aligned, size_a: int, size_b: int) -> list[str]:
    """SHA-256 of each text's groups; '' for a text without any."""
    if not len(a.ids):
        return [""] * (len(groups.first) - 1)
    letters, stops = _written(a.ids, b.ids, groups, size_a, size_b)
    stops = np.concatenate([[0], stops])
    places = stops[groups.first]
    return [
        hashlib.sha256(letters[start : stop - 1].tobytes()).hexdigest() if stop > start else ""
        for start, stop in zip(places[:-1], places[1:])
    ]


def text_batches(batches: Iterator[pa.RecordBatch], column: int, chars: int):
    """(rows, texts): consecutive rows whose texts together reach `chars` characters."""
    rows, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for at, text in enumerate(batch.column(column)):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield [*rows, batch.slice(start, at + 1 - start)], texts
                rows, texts, size, start = [], [], 0, at + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if texts:
        yield rows, texts


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per document: doc_id, the counts, the digest, its batch, and its distinct linked
    pairs (`at`, places in the batch's list, as differences) with their `times`, both packed as
    little-endian 32-bit numbers. The last row of a batch holds the batch's list: `pairs`
    (A id << 32 | B id) in order and how many `links` each has there.
    """
    schema = T.StructType(
        [
            T.StructField("batch", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *[T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")],
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("at", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("links", T.ArrayType(T.LongType())),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_a, vocabulary_b = byte_level(path_a), pieces(path_b)
        number = TaskContext.get().partitionId() << 33
        for rows, texts in text_batches(batches, 1, batch_chars):
            a, b = token_arrays(texts, vocabulary_a, vocabulary_b)
            groups = align(a, b, vocabulary_a, vocabulary_b)
            digests = group_digests(a, b, groups, len(vocabulary_a.tokens), len(vocabulary_b.tokens))
            linked = a.ids[groups.last_a] << 32 | b.ids[groups.last_b]
            own, times = [], []
            for start, stop in zip(groups.first[:-1], groups.first[1:]):
                found, count = np.unique(linked[start:stop], return_counts=True)
                own.append(found)
                times.append(count)
            pairs, place = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(place, np.concatenate(times), len(pairs)).astype(np.int64)
            stops = np.cumsum([len(found) for found in own])
            at = [
                np.diff(place[stop - len(found) : stop], prepend=0).astype("<i4").tobytes()
                for stop, found in zip(stops, own)
            ]
            n, n_groups = len(texts), np.diff(groups.first)
            doc_ids = pa.concat_arrays([part.column(0) for part in rows])
            last = np.zeros(n + 1, np.int32)
            last[-1] = len(pairs)
            empty = pa.array([*[True] * (n - 1), False])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)),
                    doc_ids,
                    pa.array(np.diff(a.first)),
                    pa.array(np.diff(b.first)),
                    pa.array(n_groups),
                    pa.array(n_groups),  # a group's last tokens, and no others, end together
                    pa.array(digests, pa.string()),
                    pa.array(at, pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for c in times], pa.binary()),
                    pa.ListArray.from_arrays(last, pa.array(pairs, pa.int64()), mask=empty),
                    pa.ListArray.from_arrays(last, pa.array(total, pa.int64()), mask=empty),
                ],
                names=schema.names,
            )
            number += 1

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def batch_pairs(aligned: DataFrame) -> DataFrame:
    """(batch, at, pair, links): the list of each batch, a row per pair."""
    listed = aligned.where("pairs is not null").select(
        "batch", F.posexplode(F.arrays_zip("pairs", "links")).alias("at", "_pair")
    )
    return listed.select("batch", "at", F.col("_pair.pairs").alias("pair"), "_pair.links")


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, count, is_best) over the corpus; best pairs have the highest count of their B id.

    A B id meets at most as many A ids as there are, which bounds its window."""
    counts = listed.groupBy("pair").agg(F.sum("links").alias("count"))
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    of_b = Window.partitionBy("b_id")
    return (
        counts.withColumn("b_id", low)
        .withColumn("is_best", F.col("count") == F.max("count").over(of_b))
        .select("pair", "count", "is_best")
    )


def alignment_table(listed: DataFrame) -> DataFrame:
    """(a_id, b_id, count, is_best): the corpus-wide table of linked ids."""
    return pair_counts(listed).select(
        F.shiftright("pair", 32).alias("a_id"),
        F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"),
        "count",
        "is_best",
    )


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum: each batch meets the sums of its own pairs."""
    listed = batch_pairs(aligned)
    answers = listed.join(pair_counts(listed), "pair").select(
        F.col("batch").alias("to_batch"), "at", "count", "is_best"
    )
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.select("batch", *kept, "at", "times")
    schema = T.StructType(
        [*[aligned.schema[name] for name in kept]]
        + [T.StructField(name, T.LongType()) for name in ("n_best", "count_sum")]
    )

    def sums(texts: pa.Table, answer: pa.Table) -> pa.Table:
        at = answer.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = answer.column("count").to_numpy()
        best[at] = answer.column("is_best").to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(texts.column("at"), texts.column("times")):
            place = np.cumsum(np.frombuffer(places.as_py(), "<i4"))
            time = np.frombuffer(times.as_py(), "<i4").astype(np.int64)
            n_best.append(int(time @ best[place]))
            count_sum.append(int(time @ count[place]))
        columns = [texts.column(name) for name in kept]
        return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema.names)

    return rows.groupBy("batch").cogroup(answers.groupBy("to_batch")).applyInArrow(sums, schema)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_diagonal_run_skipping(spark, sf_dir: str) -> DataFrame:
    aligned = saved(aligned_texts(table(spark, sf_dir, "documents"), *tokenizer_paths()), "aligned-texts")
    return with_link_counts(aligned)
