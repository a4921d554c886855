"""Personal data by a semi-Markov conditional random field.

Expressions find the base spans. What they drop or merge, such as two numbers side by side, is the
field's part: a text's windows (stretches of the characters that emails or numbers are written in)
are cut into tokens, and every run of at most 40 tokens that is well formed for a kind (checksum, octets,
number of digits) is a candidate segment. Features look at a candidate as a whole: digit groups,
separators, domain, brackets, the characters beside it. Dynamic programming over (position, kind) picks the best
segmentation of a window, boundaries and kinds jointly; tokens outside an entity are segments of one.
No candidate crosses a window, so deciding window by window decides the whole text.

The field is trained on a bounded sample of windows whose base spans are the labels, by the gradient
of the log-likelihood, with sums over all segmentations. Windows in which an expression dropped a
match for its length are no examples. Segments that the field finds beside the base spans, without
touching one, are added.

Spans count code points, the end exclusive. Defined results: a null text is empty; a text without
spans has '' and the checksum of the empty string; spans of several kinds may overlap if they are
base spans, those with the same start are listed in the order of the kinds; repeated rows and equal
or null doc_ids are rows of their own; with no examples of a kind nothing of it is added; an empty
table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import saved, table

#: In the order in which spans with the same start are listed. Label 0 is no entity.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
#: The longest entity, in tokens.
LONGEST = 40
#: Windows of each kind, and of none, that the field is trained on.
EXAMPLES = 150
EPOCHS = 6
RATE = 0.5
DECAY = 1e-3
#: What an entity starts from, so that one without evidence is not found.
PRIOR = -2.0
#: Characters beside a window that features may look at.
CONTEXT = 2

DIGITS = re.compile(r"[0-9][0-9\x20.()+-]*")
BEFORE_DIGITS = frozenset(" .()+-")
MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
MAIL_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-@")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Started only where a run of digits starts, and without giving back digits: the same matches.
IP_FORM = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_FORM = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    """Whether all parts are at most 255, whatever zeros they start with."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(run: str, at: int) -> Iterator[tuple[int, int]]:
    """Leftmost matches in a run of mail characters. Whether one ends depends on what follows its
    `@` only, so each `@` is tried once, from the earliest start."""
    start = 0
    while (sign := run.find("@", start)) >= 0:
        domain = DOMAIN.match(run, sign + 1) if sign > start else None
        if domain:
            yield at + start, at + domain.end()
        start = domain.end() if domain else sign + 1


class Stretch(NamedTuple):
    """A stretch of a text, what is beside it, its base spans, and whether it can be an example."""

    start: int
    left: str
    text: str
    right: str
    base: list[tuple[int, int, int]]  # (start, kind, stop) in the text
    clear: bool


def stretches(text: str) -> list[tuple[int, int, bool]]:
    """(start, stop, of numbers): the longest stretches of number or mail characters with a digit
    or an `@` in them."""
    found, stop = [], 0
    for match in DIGITS.finditer(text):
        start = match.start()
        while start > stop and text[start - 1] in BEFORE_DIGITS:
            start -= 1
        stop = match.end()
        found.append((start, stop, True))
    stop = 0
    while (sign := text.find("@", stop)) >= 0:
        start = sign
        while start > stop and text[start - 1] in MAIL_LETTERS:
            start -= 1
        stop = MAIL_RUN.match(text, sign).end()
        found.append((start, stop, False))
    return sorted(found)


def base_spans(text: str, start: int, stop: int, of_numbers: bool) -> tuple[list, bool]:
    """The base spans of a stretch, and whether none was dropped for its length."""
    part = text[start:stop]
    if not of_numbers:
        return [(s, EMAIL, e) for s, e in emails(part, start)], True
    found, clear = [], True
    if part.count(".") >= 3:
        for m in IP_FORM.finditer(part):
            if octets(m.group()):
                found.append((start + m.start(), IP, start + m.end()))
    if len(part) >= 12:
        for m in CARD_FORM.finditer(part):
            digits = digits_of(m.group())
            if 12 <= len(digits) <= 19:
                if luhn(digits):
                    found.append((start + m.start(), CARD, start + m.end()))
            elif len(digits) > 19:
                clear = False
        for m in PHONE_FORM.finditer(part):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((start + m.start(), PHONE, start + m.end()))
            else:
                clear = False
    elif "+" in part:
        for m in PHONE_FORM.finditer(part):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((start + m.start(), PHONE, start + m.end()))
    return found, clear


def windows(text: str) -> list[Stretch]:
    """Overlapping stretches are one window; those that cannot hold an entity are left out."""
    found: list[list] = []
    for start, stop, of_numbers in stretches(text):
        base, clear = base_spans(text, start, stop, of_numbers)
        if found and start < found[-1][1]:
            last = found[-1]
            last[1], last[2], last[3] = max(stop, last[1]), last[2] + base, last[3] and clear
        else:
            found.append([start, stop, base, clear])
    return [
        Stretch(s, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT], sorted(base), clear)
        for s, e, base, clear in found
        if base or "@" in text[s:e] or sum("0" <= c <= "9" for c in text[s:e]) >= 4
    ]


# The field


class Edge(NamedTuple):
    """A segment of tokens start..stop with a label, and the features of the segment as a whole."""

    start: int
    stop: int
    label: int
    features: list[str]


def kind_of(char: str) -> str:
    """Class of a neighbouring character."""
    if not char:
        return "edge"
    if char.isalpha():
        return "letter"
    return "digit" if char.isdigit() else "space" if char.isspace() else char if char in "@.+-()" else "sign"


def features(label: int, text: str, left: str, right: str) -> list[str]:
    digits = digits_of(text)
    found = ["is", f"left {kind_of(left)}", f"right {kind_of(right)}"]
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", text))
    if label == EMAIL:
        name, domain = text.split("@", 1)
        found += [f"name {name[:1].isalnum()} {name[-1:].isalnum()}", f"dots {min(domain.count('.'), 4)}"]
        last = domain.rsplit(".", 1)[-1]
        found += [f"end {last.isalpha()} {min(len(last), 5)}", f"short {len(name) < 2}"]
    elif label == IP:
        parts = text.split(".")
        found += [f"zeros {any(len(p) > 1 and p[0] == '0' for p in parts)}", f"size {len(text)}"]
    elif label == CARD:
        separators = {c for c in text if not c.isdigit()}
        found += [f"digits {len(digits)}", f"groups {groups}"]
        found += [f"separators {len(separators)}", f"first {digits[0]}"]
    else:
        found += [f"digits {len(digits)}", f"groups {groups}"]
        found += [f"brackets {text.count('(')} {text.count(')')}", f"signs {sum(c in '.-' for c in text)}"]
    return [f"{label} {each}" for each in found]


def outside(token: str) -> list[str]:
    shape = "letters" if token[0].isalpha() else f"digits {min(len(token), 12)}" if token[0].isdigit() else token
    return ["0 is", f"0 {shape}"]


def edges(window: Stretch) -> tuple[list[Edge], list[int]]:
    """All candidate segments of a window, by their end, and where its tokens start and end."""
    tokens = TOKEN.findall(window.text)
    bounds = [0]
    for token in tokens:
        bounds.append(bounds[-1] + len(token))
    around = window.left[-1:] + window.text + window.right[:1]
    shift = len(window.left[-1:])

    def segment(i: int, j: int, label: int) -> Edge:
        s, e = bounds[i] + shift, bounds[j] + shift
        return Edge(i, j, label, features(label, around[s:e], around[s - 1 : s] if s else "", around[e : e + 1]))

    found = [Edge(i, i + 1, 0, outside(token)) for i, token in enumerate(tokens)]
    for i, token in enumerate(tokens):
        if token[0].isdigit() or token == "+":
            found += [segment(i, j, label) for j, label in number_ends(tokens, i)]
        if "@" in window.text and (token[0].isascii() and token[0].isalnum() or token in "._%+-"):
            found += [segment(i, j, EMAIL) for j in mail_ends(tokens, i)]
    return sorted(found, key=lambda e: (e.stop, e.start, e.label)), bounds


def number_ends(tokens: list[str], i: int) -> Iterator[tuple[int, int]]:
    """(end, label) of the segments from token i that are well-formed ips, cards or phones."""
    count, plus = 0, tokens[i] == "+"
    dots = single = not plus
    for j in range(i, min(i + LONGEST, len(tokens))):
        token = tokens[j]
        if token[0].isdigit():
            count += len(token)
            if count > 19:
                return
            if dots and j == i + 6 and octets("".join(tokens[i : j + 1])):
                yield j + 1, IP
            if single and count >= 12 and luhn(digits_of("".join(tokens[i : j + 1]))):
                yield j + 1, CARD
            if plus and 9 <= count <= 15:
                yield j + 1, PHONE
        elif j > i:
            if token not in " -.()":
                return
            dots = dots and token == "." and (j - i) % 2 == 1
            single = single and token in " -" and tokens[j - 1][0].isdigit()


def mail_ends(tokens: list[str], i: int) -> Iterator[int]:
    """Ends of the segments from token i with the outline of an email."""
    sign, dot = None, False
    for j in range(i, min(i + LONGEST, len(tokens))):
        token = tokens[j]
        if token == "@":
            if sign is not None or j == i:
                return
            sign = j
        elif sign is None:
            if not (token[0].isascii() and token[0].isalnum() or token in "._%+-"):
                return
        elif token == ".":
            if tokens[j - 1] in ".@":
                return
            dot = True
        elif token[0].isascii() and token[0].isalnum() or token == "-":
            if dot:
                yield j + 1
        else:
            return


class Field(NamedTuple):
    """Weights of span features and of label pairs."""

    places: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # [label before, label]

    def score(self, edge: Edge) -> float:
        return sum([self.weights[self.places[f]] for f in edge.features if f in self.places]) + (
            PRIOR if edge.label else 0.0
        )


def best_segments(field: Field, window: Stretch) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the entities in the best segmentation; of equal ones, that with fewer."""
    found, bounds = edges(window)
    labels = len(KINDS) + 1
    n = len(bounds) - 1
    best = np.full((n + 1, labels), -np.inf)
    best[0, 0] = 0.0
    back: list[list] = [[None] * labels for _ in range(n + 1)]
    for edge in found:
        from_ = best[edge.start] + field.pairs[:, edge.label]
        before = int(from_.argmax())
        value = from_[before] + field.score(edge)
        if value > best[edge.stop, edge.label]:
            best[edge.stop, edge.label] = value
            back[edge.stop][edge.label] = (edge, before)
    spans, at, label = [], n, int(best[n].argmax())
    while at:
        edge, before = back[at][label]
        if label:
            spans.append((window.start + bounds[edge.start], label, window.start + bounds[edge.stop]))
        at, label = edge.start, before
    return spans[::-1]


def logsumexp(values: np.ndarray, axis: int = 0):
    high = values.max(axis=axis)
    if np.ndim(high) == 0 and not np.isfinite(high):
        return -np.inf
    return high + np.log(np.exp(values - high).sum(axis=axis))


class Example(NamedTuple):
    """A window's segments with their features as numbers, and which of them are the labelled ones."""

    edges: list[Edge]
    features: list[np.ndarray]
    gold: list[int]
    size: int


def example(window: Stretch, places: dict[str, int]) -> Example | None:
    """None where the base spans are not a segmentation of the window into its candidates."""
    found, bounds = edges(window)
    at = {(e.start, e.stop, e.label): k for k, e in enumerate(found)}
    token = {b: i for i, b in enumerate(bounds)}
    gold, done = [], 0
    for start, label, stop in window.base:
        i, j = token.get(start - window.start), token.get(stop - window.start)
        if i is None or j is None or i < done or (i, j, label) not in at:
            return None
        gold += [at[k, k + 1, 0] for k in range(done, i)] + [at[i, j, label]]
        done = j
    gold += [at[k, k + 1, 0] for k in range(done, len(bounds) - 1)]
    numbers = [np.array([places.setdefault(f, len(places)) for f in e.features]) for e in found]
    return Example(found, numbers, gold, len(bounds) - 1)


def gradient(ex: Example, weights: np.ndarray, pairs: np.ndarray):
    """(log-likelihood, feature gradient as (numbers, values), pair gradient) of one example."""
    labels = len(pairs)
    scores = np.array([weights[f].sum() + (PRIOR if e.label else 0.0) for e, f in zip(ex.edges, ex.features)])
    forward = np.full((ex.size + 1, labels), -np.inf)
    forward[0, 0] = 0.0
    entered = np.empty(len(ex.edges))
    for k, e in enumerate(ex.edges):
        entered[k] = logsumexp(forward[e.start] + pairs[:, e.label])
        forward[e.stop, e.label] = np.logaddexp(forward[e.stop, e.label], entered[k] + scores[k])
    backward = np.full((ex.size + 1, labels), -np.inf)
    backward[ex.size] = 0.0
    total = logsumexp(forward[ex.size])
    expected_pairs = np.zeros_like(pairs)
    share = np.empty(len(ex.edges))
    for k in range(len(ex.edges) - 1, -1, -1):
        e = ex.edges[k]
        after = scores[k] + backward[e.stop, e.label]
        share[k] = np.exp(entered[k] + after - total)
        way = forward[e.start] + pairs[:, e.label] + after
        expected_pairs[:, e.label] += np.exp(way - total)
        backward[e.start] = np.logaddexp(backward[e.start], pairs[:, e.label] + after)
    value = -share
    value[ex.gold] += 1
    observed, before = np.zeros_like(pairs), 0
    for k in ex.gold:
        observed[before, ex.edges[k].label] += 1
        before = ex.edges[k].label
    likelihood = scores[ex.gold].sum() + (observed * pairs).sum() - total
    numbers = np.concatenate(ex.features)
    values = np.repeat(value, [len(f) for f in ex.features])
    return likelihood, (numbers, values), observed - expected_pairs


def train(examples: list[Stretch]) -> Field:
    """Stochastic gradient with a rate that falls per weight, in a fixed order."""
    places: dict[str, int] = {}
    ready = [e for w in examples if w.clear and (e := example(w, places)) is not None]
    weights, pairs = np.zeros(len(places)), np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    seen, seen_pairs = np.full(len(places), 1.0), np.full(pairs.shape, 1.0)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(ready)):
            _, (numbers, values), pair_values = gradient(ready[k], weights, pairs)
            step = np.bincount(numbers, values, len(places)) - DECAY * weights
            seen += step**2
            weights += RATE * step / np.sqrt(seen)
            seen_pairs += pair_values**2
            pairs += RATE * pair_values / np.sqrt(seen_pairs)
    return Field(places, weights, pairs)


# Spark

SPAN = "struct<start:int,kind:int,stop:int>"
WINDOW = f"struct<start:int,left:string,text:string,right:string,base:array<{SPAN}>,clear:boolean>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
WINDOWS = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()),
            ("left", pa.string()),
            ("text", pa.string()),
            ("right", pa.string()),
            ("base", SPANS),
            ("clear", pa.bool_()),
        ]
    )
)


def _span(span: tuple[int, int, int]) -> dict:
    return dict(zip(("start", "kind", "stop"), span))


def windowed(docs: DataFrame) -> DataFrame:
    """(doc_id, windows) of each whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("windows", T.StructType.fromDDL(f"w array<{WINDOW}>")["w"].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                each = windows(text.as_py() or "")
                found.append([w._asdict() | {"base": [_span(s) for s in w.base]} for w in each])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, WINDOWS)], names=["doc_id", "windows"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def as_window(row) -> Stretch:
    base = [(s["start"], s["kind"], s["stop"]) for s in row["base"]]
    return Stretch(row["start"], row["left"], row["text"], row["right"], base, row["clear"])


def sampled(found: DataFrame, examples: int = EXAMPLES) -> list[Stretch]:
    """Up to `examples` different windows with a base span of each kind first, and without one.

    Chosen by a hash of the window alone: the same on every run, whatever the order of rows."""
    each = found.select(F.explode("windows").alias("w")).where("w.clear").select(
        F.coalesce(F.try_element_at("w.base", F.lit(1))["kind"], F.lit(0)).alias("first"),
        F.col("w.left").alias("left"),
        F.col("w.text").alias("text"),
        F.col("w.right").alias("right"),
        F.transform(
            "w.base",
            lambda s: F.struct(
                (s["start"] - F.col("w.start")).alias("start"), s["kind"], (s["stop"] - F.col("w.start")).alias("stop")
            ),
        ).alias("base"),
    )
    different = each.where("octet_length(text) <= 400").distinct()
    order = F.xxhash64("left", "text", "right")
    near = Window.partitionBy("first", "part").orderBy(order, "text", "left", "right")
    far = Window.partitionBy("first").orderBy(order, "text", "left", "right")
    some = different.withColumn("part", F.pmod(order, F.lit(256))).withColumn("rank", F.row_number().over(near))
    few = some.where(F.col("rank") <= examples).withColumn("rank", F.row_number().over(far))
    rows = few.where(F.col("rank") <= examples).orderBy("first", "rank").collect()
    return [
        Stretch(0, row.left, row.text, row.right, [tuple(s) for s in row.base], True) for row in rows
    ]


def find_spans(found: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added): spans (start, kind, stop) of the expressions and of the field."""
    spark: SparkSession = found.sparkSession
    model = spark.sparkContext.broadcast(field)
    spans = T.StructType.fromDDL(f"s array<{SPAN}>")["s"].dataType
    schema = T.StructType([found.schema["doc_id"], T.StructField("base", spans), T.StructField("added", spans)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for each in batch.column(1):
                own = [as_window(row) for row in each.as_py()]
                base.append([_span(s) for w in own for s in w.base])
                added.append([_span(s) for w in own for s in new_spans(model.value, w)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, SPANS), pa.array(added, SPANS)], names=schema.names
            )

    return found.select("doc_id", "windows").mapInArrow(work, schema)


def new_spans(field: Field, window: Stretch) -> list[tuple[int, int, int]]:
    return [
        (start, kind, stop)
        for start, kind, stop in best_segments(field, window)
        if all(stop <= s or e <= start for s, _, e in window.base)
    ]


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.lit(list(KINDS))
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def of_kind(number: int):
    return lambda span: span["kind"] == number


def with_digests(spans: DataFrame) -> DataFrame:
    """The counts and the checksum of the base spans, and all spans written out."""
    counts = [
        F.size(F.filter("base", of_kind(n))).cast("long").alias(f"n_{kind}")
        for n, kind in enumerate(KINDS, 1)
    ]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op12_semi_markov_field(spark, sf_dir: str) -> DataFrame:
    found = saved(windowed(table(spark, sf_dir, "documents")), "windows")
    return with_digests(find_spans(found, train(sampled(found))))
