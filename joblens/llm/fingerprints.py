"""Document fingerprints by consistent weighted sampling.

A text's terms are its word shingles, weighted by how often they occur. Each of `SAMPLES` samples
picks one term and a level of its weight, with the help of two gamma variables and one uniform one
per term and sample; two texts pick the same with the probability of their generalised Jaccard
similarity. The variables come from fixed random tables, addressed by bits of the term's hash.

Defined results: null text is empty; a text without words has an empty fingerprint, which is like
another empty one (1) and unlike any other (0); rows with equal doc_id follow each other in an
order fixed by the stored table, null doc_ids come last; a table of one row has itself as the next
document; an empty table gives an empty result; extra columns are ignored.
"""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import numbered, partitions, table, text_of
from joblens.llm.shingles import shingle_hashes

SAMPLES = 64
TABLE_BITS = 13
TERMS_AT_ONCE = 4096
ROWS_PER_BUCKET = 64


@functools.cache
def random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log c; r; beta; and r * (1 - beta), which is all that a weight of 1 needs."""
    rng = np.random.default_rng(20240501)
    shape = (1 << TABLE_BITS, SAMPLES)
    log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
    r = rng.gamma(2, 1, shape).astype(np.float32)
    beta = rng.random(shape).astype(np.float32)
    return log_c, r, beta, r * (1 - beta)


def signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits per sample: of the picked term and its level. terms are distinct."""
    log_c, r, beta, unit = random_tables()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    best = np.full(SAMPLES, np.inf, np.float32)
    picked = np.zeros(SAMPLES, np.uint64)
    columns = np.arange(SAMPLES)
    for at in range(0, len(terms), TERMS_AT_ONCE):
        part, weight = terms[at : at + TERMS_AT_ONCE], weights[at : at + TERMS_AT_ONCE]
        one = (part & mask).astype(np.int64)
        two = (part >> np.uint64(20) & mask).astype(np.int64)
        value = log_c[one]
        value -= unit[two]
        heavy = np.flatnonzero(weight > 1)
        level = None
        if len(heavy):
            rate, shift = r[two[heavy]], beta[two[heavy]]
            level = np.floor(np.log(weight[heavy]).astype(np.float32)[:, None] / rate + shift)
            value[heavy] = log_c[one[heavy]] - rate * (level - shift + 1)
        least = value.argmin(0)
        found = value[least, columns]
        name = part[least]
        if level is not None:
            row = np.searchsorted(heavy, least)
            row[row == len(heavy)] = 0
            raised = np.where(heavy[row] == least, level[row, columns], 0)
            name = name + raised.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        better = found < best
        best[better] = found[better]
        picked[better] = name[better]
    return (picked >> np.uint64(40)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray | None:
    shingles = shingle_hashes(text)
    if not len(shingles):
        return None
    return signature(*np.unique(shingles, return_counts=True))


def written(mark: np.ndarray | None) -> str:
    return "" if mark is None else mark.astype(">u2").tobytes().hex()


def likeness(one: np.ndarray | None, other: np.ndarray | None) -> float:
    if one is None or other is None:
        return float(one is None and other is None)
    return float((one == other).mean())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def followed(docs: DataFrame) -> DataFrame:
    """(bucket, rank, is_copy, uid, doc_id, text), sorted in partitions by bucket and falling
    doc_id; a bucket ends with a copy of the row that comes after it. Every text moves once, the
    first one of a bucket twice."""
    spark = docs.sparkSession
    rows = numbered(docs).select(
        "uid", F.col("row.doc_id").alias("doc_id"), text_of(F.col("row.text")).alias("text")
    )
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))
    ids = rows.select(place.alias("place"))
    buckets = max(1, min(4 * partitions(spark), ids.count() // ROWS_PER_BUCKET))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(ids.approxQuantile("place", shares, 0.25 / buckets))) if shares else []
    cuts = [cut for cut in cuts if cut > -1e300]
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    sorter = Bucketizer(splits=splits, inputCol="place", outputCol="cell")
    bucket = (-F.col("cell")).cast("int")  # rising buckets hold falling doc_ids
    known = F.col("doc_id").isNotNull()
    # one row per bucket comes back: the row it starts with
    heads = (
        sorter.transform(rows.select("uid", "doc_id", place.alias("place")))
        .groupBy(bucket.alias("bucket"))
        .agg(F.max(F.struct(known.alias("known"), "doc_id", (-F.col("uid")).alias("uid"))).alias("h"))
        .select("bucket", (-F.col("h.uid")).alias("uid"))
        .orderBy("bucket")
        .collect()
    )
    names = [head.bucket for head in heads]
    before = spark.createDataFrame(
        [(head.uid, names[i - 1]) for i, head in enumerate(heads)], "head long, before int"
    )
    cells = sorter.transform(rows.withColumn("place", place)).withColumn("bucket", bucket)
    marked = cells.join(F.broadcast(before), F.col("uid") == F.col("head"), "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("is_copy"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("is_copy"))
    spread = marked.select(
        "uid",
        "doc_id",
        "text",
        F.explode(
            F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
        ).alias("to"),
    )
    return (
        spread.select("to.bucket", "to.is_copy", "uid", "doc_id", "text")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "is_copy", F.desc_nulls_last("doc_id"), "uid")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row per document: its text's fingerprint and that of its edited text."""
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for what follows it
        for batch in batches:
            is_copy = batch.column(1).to_pylist()
            names = batch.column(3)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(4).slice(at, 256).to_pylist()
                columns: list[list] = [[] for _ in kinds]
                done = []
                for i, text in enumerate(texts):
                    print_ = fingerprint(text)
                    if held is not None:
                        name, old, old_print = held
                        changed = edited(old, text)
                        changed_print = fingerprint(changed)
                        row = (
                            len(old),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            written(old_print),
                            written(changed_print),
                            likeness(old_print, changed_print),
                            likeness(old_print, print_),
                        )
                        done.append(name)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                    held = None if is_copy[at + i] else (names.slice(at + i, 1), text, print_)
                if done:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays(done),
                            *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                        ],
                        names=[field.name for field in fields],
                    )

    return followed(docs).mapInArrow(mark, T.StructType(fields))


def op9_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
