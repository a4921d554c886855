"""Exact dedup by content-defined chunk recipes.

A rolling hash over the bytes of a text sets chunk borders, so equal stretches give equal chunks.
Chunk contents move once, to one row per distinct chunk, where equality of all contents behind an
identifier is verified. After that a document is its ordered list of identifiers, and only these
lists are grouped and joined. A chunk whose identifier fails verification is carried in the lists
by its content, so the comparison is exact in any case.

Defined results: null text equals empty text, and both have no chunks; of equal texts the row with
the largest doc_id stays, null being smallest, and of repeated rows with that doc_id one stays; an
empty table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import numbered, saved, table, text_of

#: A border falls where the low bits of the hash are 0: chunks are 2 ** 10 bytes long on average.
BORDER_BITS = 10
WINDOW = 32
SMALLEST, LARGEST = 256, 8192
#: Identifiers that fail verification travel in the plan up to this many; beyond it all chunks do.
UNVERIFIED_IN_PLAN = 1000


def gear_table() -> np.ndarray:
    return np.random.default_rng(20240101).integers(0, 2**32, 256, dtype=np.uint32)


def borders(raw: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a byte array, whatever its length."""
    size = len(raw)
    if not size:
        return []
    rolled = gear[raw]
    step = 1
    while step < WINDOW:  # doubles the window: sum of gear[b] << age over the last bytes
        older = np.zeros_like(rolled)
        older[step:] = rolled[:-step] << np.uint32(step)
        rolled = rolled + older
        step *= 2
    marks = np.flatnonzero(rolled >> np.uint32(32 - BORDER_BITS) == 0) + 1
    ends, start = [], 0
    for mark in [*marks.tolist(), size]:
        if mark - start < SMALLEST and mark != size:
            continue
        while mark - start > LARGEST:
            start += LARGEST
            ends.append(start)
        if mark > start:
            ends.append(mark)
            start = mark
    return ends


def chunk_ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    gear = gear_table()
    for batch in batches:
        raw = batch.cast(pa.binary())
        found = [borders(np.frombuffer(text.as_buffer(), np.uint8), gear) for text in raw]
        yield pa.array(found, pa.list_(pa.int32()))


def with_chunks(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, raw, chunks): raw is the text in UTF-8, chunks its parts in order."""
    ends = F.arrow_udf(chunk_ends, returnType=T.ArrayType(T.IntegerType()))
    text = text_of(F.col("row.text"))
    rows = numbered(docs).select(
        "uid", F.col("row.doc_id").alias("doc_id"), text.alias("text"), ends(text).alias("ends")
    )
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    spans = F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))
    raw = F.encode("text", "utf-8")
    part = lambda s: F.substring(raw, s["start"] + 1, s["end"] - s["start"])
    chunks = F.when(F.size("ends") == 0, F.array().cast("array<binary>")).otherwise(
        F.transform(spans, part)
    )
    return rows.select("uid", "doc_id", F.sha2(raw, 256).alias("text_sha256"), chunks.alias("chunks"))


def identifier(chunk: Column, bits: int) -> Column:
    """128 hash bits; fewer only in tests, which plant collisions."""
    first, second = F.xxhash64(chunk), F.xxhash64(chunk, F.lit("second"))
    if bits < 64:
        first, second = F.pmod(first, F.lit(1 << bits)), F.lit(0).cast("long")
    return F.struct(first.alias("a"), second.alias("b"))


def unverified(chunked: DataFrame, bits: int) -> list[tuple[int, int]] | None:
    """Identifiers with several contents; None if there are too many to name."""
    chunks = chunked.select(F.explode("chunks").alias("chunk")).distinct()
    named = chunks.select(identifier(F.col("chunk"), bits).alias("id"))
    odd = named.groupBy("id").count().where("count > 1").select("id.*")
    found = odd.limit(UNVERIFIED_IN_PLAN + 1).collect()
    return None if len(found) > UNVERIFIED_IN_PLAN else [(row.a, row.b) for row in found]


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(uid, doc_id, text_sha256, recipe), stored: the ordered identifiers of a text's chunks."""
    chunked = with_chunks(docs)
    odd = unverified(chunked, bits)

    def item(chunk: Column) -> Column:
        name = identifier(chunk, bits)
        if odd is None:
            content = chunk
        elif odd:
            names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in odd])
            content = F.when(F.array_contains(names, name), chunk)
        else:
            content = F.lit(None).cast("binary")
        return F.struct(name["a"].alias("a"), name["b"].alias("b"), content.alias("content"))

    listed = chunked.select("uid", "doc_id", "text_sha256", F.transform("chunks", item).alias("recipe"))
    return saved(listed, "dedup-recipes")


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256), a row per document."""
    rows = recipes(docs, bits)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid")
    groups = rows.groupBy("recipe").agg(
        F.max(order).alias("best"), F.count("*").alias("group_size")
    )
    # no row moves its text; a hot recipe's rows only meet one group row, and AQE splits them
    return rows.join(groups, "recipe").select(
        "uid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "text_sha256",
    )


def op5_chunk_recipes(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP5_SQL = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
