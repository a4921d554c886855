"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own. The
others are dealt out to blocks of bounded size; each block is a packing problem that several
islands (a population each, one Spark row each) solve in parallel. A child takes over whole
well-filled bins of one parent, drops the bins of the other parent that share documents with them,
and best-fits the documents this displaces. Between epochs every island sends its elite to the
next one. Bins that stay badly filled are dissolved and dealt out anew over fewer blocks.

Defined results: a null text is empty; an empty text is the end id alone; an empty table gives an
empty result; repeated rows are packed as often as they come; null doc_ids stay null; extra columns
are ignored; a text of any length is cut into as many pieces as it needs.
"""

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblens.llm.common import partitions, saved, table

CAPACITY = 1024
END_ID = 2
BLOCK_ITEMS = 4096
ISLANDS = 3
POPULATION = 4
EPOCHS = 2
GENERATIONS = 4
ROUNDS = 3
#: A bin with more free places than this share is dissolved, but for the last round.
SLACK = 1 / 256


@functools.cache
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder(path: str):
    """Text to ids. The rank file beside the tokenizer holds the same vocabulary and is faster;
    texts with a special token's name go through the tokenizer itself, which is kept in memory
    from the first such text on."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    special = [token.content for token in added.values()]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        if any(name in text for name in special):
            return whole_tokenizer(path).encode(text, add_special_tokens=False).ids
        return plain.encode_ordinary(text)

    return encode


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def narrowed(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones if they all fit."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if len(ids) and numbers.max() < 1 << 16 else ids


def widened(pieces: DataFrame) -> DataFrame:
    """pieces whose ids are all 32-bit numbers again; a piece's length tells which ones are not.
    Without Python, whose workers would hold the widest rows of the query."""
    # two hexadecimal digits a byte: four are an id, and four noughts its upper half
    wide = F.unhex(F.regexp_replace(F.hex("ids"), "(.{4})", "$10000"))
    narrow = F.length("ids") == 2 * F.col("length")
    return pieces.withColumn("ids", F.when(narrow, wide).otherwise(F.col("ids")))


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, narrow: bool = False
):
    """(pid, doc_id, piece, start, length, ids): the documents' ids in pieces; ids are packed as
    little-endian unsigned 32-bit numbers, with narrow as 16-bit ones in pieces whose ids all fit
    (`widened` undoes it). pid numbers the pieces. Of a long document the first piece takes the
    rest, all others are full."""
    fields = [
        T.StructField("pid", T.LongType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        next_pid = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    packed = np.array(encode(text or ""), "<u4").tobytes() + end
                    total = len(packed) // 4
                    stops = range((total - 1) % capacity + 1, total + 1, capacity)
                    start = 0
                    for piece, stop in enumerate(stops):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(stop - start)
                        held = packed[4 * start : 4 * stop]
                        ids.append(narrowed(held) if narrow else held)
                        start = stop
                pids = np.arange(next_pid, next_pid + len(rows))
                next_pid += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pids, pa.int64()),
                        part.column(0).take(pa.array(rows, pa.int32())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[field.name for field in fields],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, T.StructType(fields)
    )


class Bins:
    """Bins by their free places; finds the tightest bin that takes an item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # a bit for each level that has bins
        self.count = 0

    def put(self, free: int, number: int) -> None:
        self.levels[free].append(number)
        self.filled |= 1 << free

    def fit(self, length: int) -> int:
        above = self.filled >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            level = self.levels[free]
            number = level.pop()
            if not level:
                self.filled &= ~(1 << free)
        else:
            free, number = self.capacity, self.count
            self.count += 1
        self.put(free - length, number)
        return number


def best_fit(lengths: list[int], order, capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.empty(len(lengths), np.int32)
    for item in order:
        out[item] = bins.fit(lengths[item])
    return out


def crossover(
    one: np.ndarray, other: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random
) -> np.ndarray:
    """Well-filled bins of `other` go whole into `one`; what they displace is best-fitted."""
    fill = np.bincount(other, lengths, other.max() + 1)
    good = np.flatnonzero(fill >= capacity * rng.choice((1.0, 0.998, 0.99)))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.sample(good.tolist(), (len(good) + 1) // 2)] = True
    injected = chosen[other]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[injected]] = True
    stays = ~broken[one]
    lost = np.flatnonzero(~stays & ~injected)
    # the injected bins come first, then those of `one` that stay
    child = np.full(len(one), -1, np.int64)
    for kept, source, shift in ((injected, other, 0), (stays, one, len(fill))):
        child[kept] = source[kept] + shift
    placed = np.flatnonzero(child >= 0)
    names, numbers = np.unique(child[placed], return_inverse=True)
    child[placed] = numbers
    bins = Bins(capacity)
    bins.count = len(names)
    used = np.bincount(numbers, lengths[placed], len(names)).astype(np.int64)
    for number, free in enumerate((capacity - used).tolist()):
        bins.put(free, number)
    for item in lost.tolist():  # items are in falling length
        child[item] = bins.fit(int(lengths[item]))
    return child.astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, those that leave the free places together."""
    fill = np.bincount(bins, lengths)
    return int(bins.max()) + 1, -float(np.square(fill / capacity).sum())


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, seed: int
) -> list[np.ndarray]:
    """The next population, best first."""
    rng = random.Random(seed)
    sizes = lengths.tolist()
    least = -(-int(lengths.sum()) // capacity)
    if not population:
        population.append(best_fit(sizes, range(len(sizes)), capacity))
    while len(population) < POPULATION and population[0].max() + 1 > least:
        shaken = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
        population.append(best_fit(sizes, shaken, capacity))
    rated = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)))
    for _ in range(generations):
        if rated[0][0][0] <= least or len(rated) < 2:
            break
        children = []
        for _ in range(POPULATION // 2):
            one, other = rng.sample(rated, 2)
            children.append(crossover(one[2], other[2], lengths, capacity, rng))
        fresh = [(fitness(c, lengths, capacity), len(rated) + i, c) for i, c in enumerate(children)]
        rated = [(f, i, p) for i, (f, _, p) in enumerate(sorted([*rated, *fresh])[:POPULATION])]
    return [p for _, _, p in rated]


def island_epoch(capacity: int, generations: int, islands: int, epoch: int, last: bool):
    """A row (block, island, lengths, population) becomes rows (block, island, bins, rank)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                population = [np.frombuffer(p, "<i4") for p in row["population"] or []]
                seed = (row["block"] * islands + row["island"]) * 1000 + epoch
                best = evolve(lengths, population, capacity, generations, seed)
                if last:
                    best = best[:1]
                out = [(row["island"], p) for p in best]
                if not last:  # the elite migrates
                    out.append(((row["island"] + 1) % islands, best[0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(out), pa.int64()),
                        pa.array([to for to, _ in out], pa.int32()),
                        pa.array([p.astype("<i4").tobytes() for _, p in out], pa.binary()),
                        pa.array([int(p.max()) + 1 for _, p in out], pa.int32()),
                    ],
                    names=["block", "island", "bins", "n_bins"],
                )

    return step


def as_numbers(numbers: str, kind: str):
    """An array column as packed little-endian numbers."""

    @F.pandas_udf("binary")
    def packed(arrays):
        return arrays.map(lambda a: np.asarray(a, kind).tobytes())

    return packed(numbers)


def solve(items: DataFrame, blocks: int, turn: int, capacity: int, islands: int) -> DataFrame:
    """(pid, length, bin, offset, fill) for items (pid, length): every block packed on its own."""
    block = F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(blocks))
    dealt = items.groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("by"), "pid"))).alias("items")
    )
    problems = saved(
        dealt.select(
            "block",
            F.col("items.pid").alias("pids"),
            as_numbers(F.transform("items.by", lambda n: (-n).cast("int")), "<i4").alias("lengths"),
        ),
        "packing-problems",
    )
    isles = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = problems.select("block", "lengths", isles).withColumn(
        "population", F.lit(None).cast("array<binary>")
    )
    # a number of partitions is given, as an island is long work on few bytes
    tasks = partitions(items.sparkSession)
    state = state.repartition(tasks, "block", "island")
    schema = "block long, island int, bins binary, n_bins int"
    for epoch in range(EPOCHS):
        last = epoch == EPOCHS - 1
        step = island_epoch(capacity, GENERATIONS, islands, epoch, last)
        population = saved(
            state.select("block", "island", "lengths", "population").mapInArrow(step, schema),
            "packing-population",
        )
        if not last:
            grouped = population.groupBy("block", "island").agg(
                F.array_sort(F.collect_list("bins")).alias("population")
            )
            state = grouped.join(problems.select("block", "lengths"), "block")
            state = state.repartition(tasks, "block", "island")
    best = population.groupBy("block").agg(
        F.min(F.struct("n_bins", "bins"))["bins"].alias("bins")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                bins = np.frombuffer(row["bins"], "<i4").astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                fresh = np.r_[True, np.diff(bins[order]) != 0]
                starts = np.maximum.accumulate(np.where(fresh, before, 0))
                offsets = np.empty_like(before)
                offsets[order] = before - starts
                fill = np.bincount(bins, lengths).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["pids"], pa.int64()),
                        pa.array(lengths),
                        pa.array(((turn * 2**40 + row["block"]) << 13) + bins),
                        pa.array(offsets),
                        pa.array(fill[bins]),
                    ],
                    names=["pid", "length", "sequence_id", "offset", "fill"],
                )

    return best.join(problems, "block").select("block", "pids", "lengths", "bins").mapInArrow(
        placed, "pid long, length long, sequence_id long, offset long, fill long"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS) -> DataFrame:
    """(pid, sequence_id, offset) for stored pieces (pid, length)."""
    done = pieces.where(F.col("length") >= capacity).select(
        "pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    items = pieces.where(F.col("length") < capacity).select("pid", "length")
    for turn in range(ROUNDS):
        count = items.count()
        if not count:
            break
        # hash dealing: a block's size spreads by its square root, so 2 ** 13 bins are never reached
        blocks = math.ceil(count / BLOCK_ITEMS)
        solved = saved(solve(items, blocks, turn, capacity, islands), "packing-solved")
        last = turn == ROUNDS - 1 or blocks == 1
        good = F.col("fill") >= math.ceil(capacity * (1 - SLACK))
        done = done.unionByName(
            solved.where(F.lit(last) | good).select("pid", "sequence_id", "offset")
        )
        if last:
            break
        items = solved.where(~good).select("pid", "length")
    return done


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its ids, and its sequence and place there. The ids are stored and
    shuffled in half the bytes."""
    pieces = saved(token_pieces(docs, path, capacity, narrow=True), "packing-pieces")
    return widened(pieces.join(pack(pieces, capacity), "pid"))


def op1_grouping_genetic_packing(spark, sf_dir: str) -> DataFrame:
    pieces = saved(
        token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()), "packing-pieces"
    )
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return digests.join(pack(pieces), "pid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
