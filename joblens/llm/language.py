"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams (n = 1, 2, 3) that
both contain, normalised by the texts' own counts. Nystroem landmarks turn it into a finite feature
map, on which one-versus-rest kernel ridge regression is solved. All of it is linear in the
presence vector, so a batch of texts is scored with one matrix product.

Training reads a bounded sample (`ROWS_PER_LANGUAGE` labelled rows of each language, of which
`LANDMARKS_PER_LANGUAGE` are landmarks); prediction reads every text whole.

Defined results: a text that is null, empty or without letters is `und` with score 0, as is every
text if no row has a label; null labels are not learned; an empty table gives an empty result;
repeated rows get equal predictions; extra columns are ignored.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import numbered, table

ROWS_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 60
RIDGE = 1e-3
#: Letters other than a to z share the symbols above 26 by a hash; all else is symbol 0.
SYMBOLS = 128
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
STRETCH = 1 << 20
TEXTS_AT_ONCE = 128


@functools.cache
def symbol_table() -> np.ndarray:
    symbols = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            if 97 <= low <= 122:
                symbols[code] = low - 96
            else:
                symbols[code] = 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return symbols


def symbols_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return symbol_table()[raw]


def grams_of(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams."""
    wide = symbols.astype(np.int32)
    yield wide
    pairs = wide[:-1] * SYMBOLS + wide[1:]
    yield pairs + SYMBOLS
    yield pairs[:-1] * SYMBOLS + wide[2:] + (SYMBOLS + SYMBOLS**2)


def presence(text: str) -> np.ndarray:
    """The distinct grams of a text, sorted."""
    symbols = symbols_of(text)
    seen = np.empty(0, np.int32)
    for at in range(0, len(symbols), STRETCH):
        part = symbols[max(0, at - 2) : at + STRETCH]
        seen = np.unique(np.concatenate([seen, *grams_of(part)]))
    return seen


def columns_of(vocabulary: np.ndarray) -> np.ndarray:
    columns = np.full(GRAMS, -1, np.int32)
    columns[vocabulary] = np.arange(len(vocabulary))
    return columns


class Model:
    """vocabulary: the gram of each column, sorted. weights: per column and language."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.vocabulary, self.weights, self.bias = languages, vocabulary, weights, bias

    @functools.cached_property
    def columns(self) -> np.ndarray:
        """A gram's column or -1; 8 MB, so a worker makes it and no message carries it."""
        return columns_of(self.vocabulary)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "columns"}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(raw score per text and language, whether the text has a letter)."""
        seen = np.zeros((len(texts), len(self.weights)), bool)
        letters = np.zeros(len(texts), bool)
        for row, text in enumerate(texts):
            symbols = symbols_of(text)
            for at in range(0, len(symbols), STRETCH):
                part = symbols[max(0, at - 2) : at + STRETCH]
                letters[row] |= part.any()
                for grams in grams_of(part):
                    found = self.columns[grams]
                    seen[row, found[found >= 0]] = True
        norms = np.sqrt(np.maximum(seen.sum(1), 1))
        return seen.astype(np.float32) @ self.weights / norms[:, None] + self.bias, letters


def fit(languages: list[str], labels: np.ndarray, texts: list[np.ndarray]) -> Model:
    """Kernel ridge regression on landmarks; texts as their distinct grams."""
    landmarks = np.concatenate(
        [np.flatnonzero(labels == i)[:LANDMARKS_PER_LANGUAGE] for i in range(len(languages))]
    )
    vocabulary = np.unique(np.concatenate([texts[i] for i in landmarks]))
    columns = columns_of(vocabulary)

    def rows(numbers) -> np.ndarray:
        matrix = np.zeros((len(numbers), len(vocabulary)), np.float32)
        for row, number in enumerate(numbers):
            found = columns[texts[number]]
            matrix[row, found[found >= 0]] = 1
        return matrix / np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))

    base = rows(landmarks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    strong = values > values.max() * 1e-6
    half = vectors[:, strong] / np.sqrt(values[strong])
    project = base.T @ half.astype(np.float32)
    features = np.concatenate(
        [rows(range(at, min(at + 256, len(texts)))) @ project for at in range(0, len(texts), 256)]
    ).astype(np.float64)
    wanted = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    shift, bias = features.mean(0), wanted.mean(0)
    centred = features - shift
    ridge = RIDGE * len(texts) * np.eye(centred.shape[1])
    solved = np.linalg.solve(centred.T @ centred + ridge, centred.T @ (wanted - bias))
    weights = project @ solved.astype(np.float32)
    return Model(languages, vocabulary, weights, (bias - shift @ solved).astype(np.float32))


def train(docs: DataFrame, usable) -> Model | None:
    """Learns from text and lang of the usable rows; usable is a column of docs."""
    rows = numbered(docs.withColumn("usable", usable)).where(
        "row.usable and row.lang is not null and row.text is not null"
    )
    rows = rows.select(
        "uid", F.col("row.lang").cast("string").alias("lang"), F.col("row.text").cast("string").alias("text")
    )
    counts = rows.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("uid", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # drawn without the texts; about ROWS_PER_LANGUAGE numbers for each language remain
    drawn = rows.select("uid", "lang").join(counts, "lang").where(draw * F.col("count") < ROWS_PER_LANGUAGE)
    sample = rows.join(F.broadcast(drawn.select("uid")), "uid", "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [presence(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], names=["lang", "grams"]
            )

    # bounded: about ROWS_PER_LANGUAGE rows for each language, as sets of grams
    learned = sample.select("lang", "text").mapInArrow(grams, "lang string, grams binary").collect()
    if not learned:
        return None
    learned.sort(key=lambda row: (row.lang, bytes(row.grams)))
    rng = np.random.default_rng(7)
    learned = [learned[i] for i in rng.permutation(len(learned))]
    languages = sorted({row.lang for row in learned})
    labels = np.array([languages.index(row.lang) for row in learned])
    return fit(languages, labels, [np.frombuffer(row.grams, np.int32) for row in learned])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the columns of docs; text names the column or field read."""
    schema = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                texts = [text or "" for text in batch.slice(at, TEXTS_AT_ONCE).to_pylist()]
                if model is None:
                    out += [("und", 0.0)] * len(texts)
                    continue
                raw, letters = model.scores(texts)
                best = raw.argmax(1)
                top = np.clip((raw[np.arange(len(texts)), best] + 1) / 2, 0, 1)
                out += [
                    (model.languages[b], float(s)) if known else ("und", 0.0)
                    for b, s, known in zip(best, top, letters, strict=True)
                ]
            yield pa.array([{"lang_pred": a, "score": b} for a, b in out], kind)

    found = F.arrow_udf(score, returnType=schema)(F.col(text).cast("string"))
    named = docs.withColumn("__found", found)
    return named.withColumns(
        {"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}
    ).drop("__found")


def held_out():
    """A quarter of the documents, never learned from. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and predicts all."""
    return predict(docs, train(docs, ~held_out()))


def op4_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
