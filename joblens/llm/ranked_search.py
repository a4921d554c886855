"""Ranked lexical search with hashed max-sketches.

A document's sketch holds, at each of two hashed coordinates of each of its terms, the largest count
of the terms that fold there. A term's impact rises with its count, so the smaller of a query
term's two coordinates bounds its impact, and weights times these, as one matrix product per block
of documents, bound the scores of a batch of queries. The documents with the highest bounds of each
query are scored exactly, which gives a threshold; all others whose bound reaches it are scored in
descending order of bound, while the threshold goes on rising, so no document of a result is missed.

Sketches have 8 coordinates per distinct term (a power of two), counts are kept up to 254 and above
that as no bound on the count. The index holds every document and does not know the queries.

Scores are integers: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact
(10^9 * tf) div (1000 * tf + 8m) with m = 10 + (90 * n * N) div L.

Defined results: a null or empty text has no terms and does not count as a document; an item without
terms has no results; repeated rows of either table are documents or items of their own; equal
scores go by doc_id, null last, then by the row's place; an empty table gives an empty result;
extra columns are ignored; a text of any length is read whole.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import is_stored, saved, table

BEST = 10
#: Documents per query that are scored first, for the threshold.
FIRST = 64
#: Coordinates per distinct term, and at least.
SPARSE = 8
NARROWEST = 256
#: A count that is not kept: any count from here up.
OPEN_COUNT = 255
HIGHEST_IMPACT = 1_000_000
#: A batch of documents ends with the text that brings it to this many characters.
BATCH_CHARS = 2_000_000
#: Documents of one matrix product, and cells of their sketches.
ROWS_PER_PRODUCT = 256
CELLS_PER_PRODUCT = 1 << 23
#: Queries are answered in blocks of about so many items and characters.
BLOCK_ITEMS = 512
BLOCK_CHARS = 200_000

#: Letters, digits and all bytes of other characters are kept, A-Z as a-z; the rest is a space.
KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(KEPT).split() if text else []


def coordinates(terms) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each term; the second mixes all bits of the first."""
    first = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))
    return first, (first * 0x9E3779B1 & 0xFFFFFFFF) >> 7


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """(file, place, columns): a row's file, as a hash, and its place there, the same on every read."""
    if not is_stored(rows):
        rows = saved(rows, "placed-rows")
    at = rows.metadataColumn("_metadata")
    return rows.select(
        F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place"), *columns
    )


# Index


def _widths(distinct: np.ndarray) -> np.ndarray:
    """The next power of two of SPARSE times the distinct terms."""
    wanted = np.maximum(distinct * SPARSE, NARROWEST)
    return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def _cell_type(width: int):
    """Two sketches have 2 * width cells, numbered in two bytes where that is enough."""
    return np.dtype("<u2" if width <= 1 << 15 else "<u4")


def sketches(counts: list[Counter]) -> list[tuple[int, bytes]]:
    """Per document the width of its two sketches, and their cells that are not 0: the places (those
    of the second sketch follow those of the first), then the maxima. Width 0 without terms."""
    distinct = np.array([len(c) for c in counts], np.int64)
    widths = np.where(distinct > 0, _widths(distinct), 0)
    starts = np.cumsum(2 * widths) - 2 * widths
    cells = np.zeros(int(2 * widths.sum()), np.uint8)
    first, second = coordinates([term for c in counts for term in c])
    found = np.fromiter((n for c in counts for n in c.values()), np.int64, len(first))
    found = np.minimum(found, OPEN_COUNT).astype(np.uint8)
    start, width = np.repeat(starts, distinct), np.repeat(widths, distinct)
    np.maximum.at(cells, start + (first & (width - 1)), found)
    np.maximum.at(cells, start + width + (second & (width - 1)), found)
    packed = []
    for at, w in zip(starts.tolist(), widths.tolist()):
        own = cells[at : at + 2 * w]
        places = np.flatnonzero(own)
        packed.append((w, places.astype(_cell_type(w)).tobytes() + own[places].tobytes()))
    return packed


def unpacked(width: int, packed: list[bytes]) -> np.ndarray:
    """Documents x 2 * width: the sketches of documents of one width."""
    cells = np.zeros((len(packed), 2 * width), np.uint8)
    kind = _cell_type(width)
    for row, data in zip(cells, packed):
        size = len(data) // (kind.itemsize + 1)
        row[np.frombuffer(data, kind, size)] = np.frombuffer(data, np.uint8, size, size * kind.itemsize)
    return cells


INDEX = (
    "file long, place long, n long, width int, sketch binary, terms array<binary>, holders array<long>"
)


def build_index(docs: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(file, place, n, width, sketch) per document; the last row of each batch of documents also has the
    batch's distinct terms and how many of its documents hold each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in counted_batches(batches):
            holders = Counter()
            for c in counts:
                holders.update(c.keys())
            last = np.zeros(len(counts) + 1, np.int32)
            last[-1] = len(holders)
            empty = pa.array([*[True] * (len(counts) - 1), False])
            terms = pa.array(holders.keys(), pa.binary())
            widths, packed = zip(*sketches(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([part.column(0) for part in rows]),
                    pa.concat_arrays([part.column(1) for part in rows]),
                    pa.array([c.total() for c in counts], pa.int64()),
                    pa.array(widths, pa.int32()),
                    pa.array(packed, pa.binary()),
                    pa.ListArray.from_arrays(last, terms, mask=empty),
                    pa.ListArray.from_arrays(last, pa.array(holders.values(), pa.int64()), mask=empty),
                ],
                names=["file", "place", "n", "width", "sketch", "terms", "holders"],
            )

    def counted_batches(batches):
        rows, counts, size = [], [], 0
        for batch in batches:
            start = 0
            for at, text in enumerate(batch.column(2)):
                text = text.as_py()
                counts.append(Counter(terms_of(text)))
                size += len(text or "")
                if size >= batch_chars:
                    yield [*rows, batch.slice(start, at + 1 - start)], counts
                    rows, counts, size, start = [], [], 0, at + 1
            if start < batch.num_rows:
                rows.append(batch.slice(start))
        if counts:
            yield rows, counts

    texts = placed(docs, F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, INDEX)


class Corpus(NamedTuple):
    documents: int
    terms: int

    def m(self, n):
        return 10 + (90 * n * self.documents) // self.terms


def corpus_of(index: DataFrame) -> Corpus:
    row = index.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    return Corpus(row[0], row[1] or 0)


# Queries


class Queries(NamedTuple):
    """A block of items. Entry e says that term `term[e]` belongs to query `query[e]`."""

    rows: list  # item_id of each query
    terms: list[bytes]
    query: np.ndarray
    term: np.ndarray


def query_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS):
    """The items block by block; a block goes through the driver, its size does not grow with the table."""
    rows = placed(items, "item_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, math.ceil(size[0] / block_items), math.ceil((size[1] or 0) / block_chars))
    number = F.pmod(F.xxhash64("file", "place"), F.lit(blocks))
    for block in range(blocks):
        found = rows.where(number == block).orderBy("file", "place").collect()
        each = [sorted(set(terms_of(row.text))) for row in found]
        terms = sorted(set().union(*each))
        at = {term: i for i, term in enumerate(terms)}
        if terms:
            yield Queries(
                [row.item_id for row in found],
                terms,
                np.repeat(np.arange(len(each)), [len(own) for own in each]),
                np.array([at[term] for own in each for term in own]),
            )


def weights(index: DataFrame, queries: Queries, corpus: Corpus) -> np.ndarray:
    """The weight of each of the block's terms, 0 for terms that no document holds."""
    spark = index.sparkSession
    asked = spark.createDataFrame(list(enumerate(queries.terms)), "at int, term binary")
    held = index.where("terms is not null").select(
        F.explode(F.arrays_zip("terms", "holders")).alias("_held")
    )
    counts = (
        held.select(F.col("_held.terms").alias("term"), "_held.holders")
        .join(F.broadcast(asked), "term")  # no more rows than a block of items has terms
        .groupBy("at")
        .agg(F.sum("holders").alias("df"))
    )
    weight = np.zeros(len(queries.terms), np.int64)
    for row in counts.collect():
        weight[row["at"]] = math.floor(1000 * math.log((2 * corpus.documents + 2) / (2 * row["df"] + 1)))
    return weight


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Bounds:
    """Upper bounds of the scores of documents for a block of queries."""

    def __init__(self, queries: Queries, weight: np.ndarray, corpus: Corpus):
        self.corpus = corpus
        self.first, self.second = coordinates(queries.terms)
        self.matrix = np.zeros((len(queries.terms), len(queries.rows)), np.float32)
        self.matrix[queries.term, queries.query] = weight[queries.term]
        longest = np.bincount(queries.query).max()
        # rounding of a sum of that many products
        self.margin = np.float32(1 + (longest + 8) * 2.0**-22)

    def of(self, n: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Documents x queries; `cells` are the sketches of documents of one width."""
        width = cells.shape[1] // 2
        counts = np.minimum(
            cells[:, self.first & (width - 1)], cells[:, width + (self.second & (width - 1))]
        )
        row, term = np.nonzero(counts)
        tf = counts[row, term].astype(np.int64)
        impact = np.where(tf == OPEN_COUNT, HIGHEST_IMPACT, impacts(tf, self.corpus.m(n[row])))
        found = np.zeros(counts.shape, np.float32)
        found[row, term] = impact
        return found @ self.matrix * self.margin

    def blocks(self, batch: pa.RecordBatch):
        """(rows of the batch, bounds), some documents of one width at a time."""
        n, widths = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for width in np.unique(widths[widths > 0]).tolist():
            rows = np.flatnonzero(widths == width)
            size = max(1, min(ROWS_PER_PRODUCT, CELLS_PER_PRODUCT // (2 * width)))
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                packed = batch.column(4).take(pa.array(part)).to_pylist()
                yield part, self.of(n[part], unpacked(width, packed))


def top(rows: DataFrame, key: str, order: list[Column], n: int, spread_by: list[str]) -> DataFrame:
    """The first n rows per key with their rank; first among the rows of each of many parts."""
    part = F.pmod(F.xxhash64(*spread_by), F.lit(256))
    parts = rows.withColumn("_part", part)
    near = Window.partitionBy(key, "_part").orderBy(*order)
    far = Window.partitionBy(key).orderBy(*order)
    some = parts.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n)
    return some.withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= n).drop("_part")


def highest_bounds(index: DataFrame, bounds, n_queries: int, n: int = FIRST) -> DataFrame:
    """(query, file, place, bound): the n documents with the highest bounds of each query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, n_queries), np.float32)
        keys = np.zeros((2, 0, n_queries), np.int64)
        for batch in batches:
            places = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            for rows, found in bounds.value.blocks(batch):
                own = np.broadcast_to(places[:, rows, None], (2, *found.shape))
                best, keys = np.concatenate([best, found]), np.concatenate([keys, own], axis=1)
                if len(best) > n:
                    order = np.argpartition(best, len(best) - n, axis=0)[-n:]
                    best = np.take_along_axis(best, order, 0)
                    keys = np.take_along_axis(keys, order[None], 1)
        at, query = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query.astype(np.int32)),
                pa.array(keys[0, at, query]),
                pa.array(keys[1, at, query]),
                pa.array(best[at, query].astype(np.float64)),
            ],
            names=["query", "file", "place", "bound"],
        )

    some = index.select("file", "place", "n", "width", "sketch").mapInArrow(
        work, "query int, file long, place long, bound double"
    )
    order = [F.desc("bound"), F.col("file"), F.col("place")]
    return top(some, "query", order, n, ["file", "place"]).drop("rank")


CANDIDATES = "file long, place long, queries array<int>, bounds array<double>"


def reaching(index: DataFrame, bounds, threshold: np.ndarray) -> DataFrame:
    """(file, place, queries, bounds): the documents whose bound reaches a query's threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, place = batch.column(0), batch.column(1)
            for rows, found in bounds.value.blocks(batch):
                row, query = np.nonzero(found >= threshold)
                hit, count = np.unique(row, return_counts=True)
                stops = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                take = pa.array(rows[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        file.take(take),
                        place.take(take),
                        pa.ListArray.from_arrays(stops, pa.array(query.astype(np.int32))),
                        pa.ListArray.from_arrays(stops, pa.array(found[row, query].astype(np.float64))),
                    ],
                    names=["file", "place", "queries", "bounds"],
                )

    return index.select("file", "place", "n", "width", "sketch").mapInArrow(work, CANDIDATES)


class Scorer:
    """Exact scores of documents for a block of queries."""

    def __init__(self, queries: Queries, weight: np.ndarray, corpus: Corpus):
        self.corpus = corpus
        self.at = {term: i for i, term in enumerate(queries.terms)}
        self.weight = weight.tolist()
        stops = np.searchsorted(queries.query, np.arange(len(queries.rows) + 1))
        self.terms = [queries.term[a:b].tolist() for a, b in zip(stops[:-1], stops[1:])]

    def parts(self, text: str | None) -> dict[int, int]:
        """Weight times impact of each of the block's terms in a text."""
        words = terms_of(text)
        m = self.corpus.m(len(words)) if words else 0
        counts = Counter(words)
        return {
            at: self.weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            for term, tf in counts.items()
            if (at := self.at.get(term)) is not None
        }

    def score(self, parts: dict[int, int], query: int) -> int:
        return sum([parts.get(at, 0) for at in self.terms[query]])


class BestOf:
    """The best rows of each query so far: (-score, doc_id is null, doc_id, file, place)."""

    def __init__(self, n: int):
        self.n = n
        self.rows: dict[int, list[tuple]] = {}
        self.threshold: dict[int, int] = {}

    def add(self, query: int, row: tuple) -> None:
        rows = self.rows.setdefault(query, [])
        rows.append(row)
        if len(rows) >= 4 * self.n:
            self.cut(query)

    def cut(self, query: int) -> None:
        rows = self.rows[query]
        rows.sort(key=lambda row: (row[0], row[1], 0 if row[1] else row[2], *row[3:]))
        del rows[self.n :]
        if len(rows) == self.n:
            self.threshold[query] = -rows[-1][0]


def rescored(docs: DataFrame, candidates: DataFrame, scorer, n: int) -> DataFrame:
    """(query, score, doc_id, file, place): the n best documents of each query among the candidates.

    A task takes the documents of an Arrow batch in descending order of bound and leaves out pairs
    whose bound is below the n-th best score it has found."""
    texts = placed(docs, "doc_id", F.col("text").cast("string").alias("text"))
    wanted = texts.join(candidates, ["file", "place"])
    names = ["file", "place", "doc_id", "text", "queries", "bounds"]
    schema = T.StructType.fromDDL("query int, score long, file long, place long")
    schema.add(T.StructField("doc_id", docs.schema["doc_id"].dataType))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, score = BestOf(n), scorer.value
        for batch in batches:
            rows = {name: batch.column(i) for i, name in enumerate(names)}
            bounds = rows["bounds"].to_pylist()
            for at in sorted(range(batch.num_rows), key=lambda i: -max(bounds[i])):
                left = [
                    query
                    for query, bound in zip(rows["queries"][at].as_py(), bounds[at])
                    if bound >= best.threshold.get(query, 0)
                ]
                if not left:
                    continue
                parts = score.parts(rows["text"][at].as_py())
                doc_id = rows["doc_id"][at].as_py()
                key = (doc_id is None, doc_id, rows["file"][at].as_py(), rows["place"][at].as_py())
                for query in left:
                    if (found := score.score(parts, query)) > 0:
                        best.add(query, (-found, *key))
            for query in best.rows:
                best.cut(query)
        flat = [(query, *row) for query, own in best.rows.items() for row in own]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row[0] for row in flat], pa.int32()),
                pa.array([-row[1] for row in flat], pa.int64()),
                pa.array([row[4] for row in flat], pa.int64()),
                pa.array([row[5] for row in flat], pa.int64()),
                pa.array([row[3] for row in flat], doc_type),
            ],
            names=schema.names,
        )

    doc_type = _arrow_type(docs, "doc_id")
    some = wanted.select(*names).mapInArrow(work, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("file"), F.col("place")]
    return top(some, "query", order, n, ["file", "place"])


def _arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def search(docs: DataFrame, items: DataFrame, n: int = BEST, first: int = FIRST, **blocks) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's n best documents."""
    spark = docs.sparkSession
    if not is_stored(docs):
        docs = saved(docs, "searched-rows")
    index = saved(build_index(docs), "sketch-index")
    corpus = corpus_of(index)
    schema = T.StructType(
        [
            items.schema["item_id"],
            T.StructField("rank", T.IntegerType()),
            docs.schema["doc_id"],
            T.StructField("score", T.LongType()),
        ]
    )
    found = spark.createDataFrame([], schema)
    for queries in query_blocks(items, **blocks) if corpus.documents else ():
        found = found.unionByName(search_block(spark, docs, index, corpus, queries, n, first, items))
    return found


def search_block(
    spark: SparkSession, docs, index, corpus: Corpus, queries: Queries, n: int, first: int, items
) -> DataFrame:
    weight = weights(index, queries, corpus)
    bounds = spark.sparkContext.broadcast(Bounds(queries, weight, corpus))
    scorer = spark.sparkContext.broadcast(Scorer(queries, weight, corpus))
    highest = highest_bounds(index, bounds, len(queries.rows), first)
    few = highest.groupBy("file", "place").agg(
        F.collect_list("query").alias("queries"), F.collect_list("bound").alias("bounds")
    )
    # No more rows than `first` per item of the block, however many documents there are.
    scored = rescored(docs, F.broadcast(few), scorer, n)
    threshold = np.ones(len(queries.rows), np.float32)
    for row in scored.where(F.col("rank") == n).collect():
        threshold[row["query"]] = row["score"]
    # a threshold that rounding raised must not hide a document
    threshold = threshold * np.float32(1 - 2.0**-20)
    candidates = saved(reaching(index, bounds, threshold), "candidates")
    best = rescored(docs, candidates, scorer, n)
    names = spark.createDataFrame(
        list(enumerate(queries.rows)), T.StructType([T.StructField("query", T.IntegerType()), items.schema["item_id"]])
    )
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def op13_hashed_max_sketches(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
with counted as (select doc_id, row_number() over () as place, {_TERMS} as terms from documents),
sized as (select doc_id, place, terms, len(terms) as n from counted where len(terms) > 0),
corpus as (select count(*) as nn, sum(n)::bigint as ll from sized),
held as (select place, term, count(*) as tf from (select place, unnest(terms) as term from sized) t group by all),
asked as (select distinct item, item_id, term from
            (select row_number() over () as item, item_id, unnest({_TERMS}) as term from benchmark) b),
weighed as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as w
            from held, corpus where term in (select term from asked) group by term, nn),
scored as (select item, item_id, place, doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
           from asked join weighed using (term) join held using (term) join sized using (place), corpus
           group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id, place) as rank
           from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {BEST}
"""
