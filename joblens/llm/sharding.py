"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring of 2 ** 14 places. A key belongs to the first shard
clockwise from its own place that has room; there is room up to `1 + slack` times the mean load.
Rows claim their places by size, the largest first (in classes of powers of two), within a class in
the order of a hash. A row that does not fit moves on clockwise, and its shard is passed by for the
rest of its class; smaller rows may still fill it. If no shard has room for a row, the first one below
its limit takes it. So no shard exceeds its limit by more than one turn of rows.

What a row gets depends only on which shards were passed by at its turn. These changes, a few for
each class, are found on a table of sizes by arc of the ring and turn, which does not grow with the
rows beyond a bound.

Defined results: null text has no bytes and checksum 0, size 1; rows with equal or null keys share
a place on the ring and still have turns of their own, so that a key with a third of all rows
overflows clockwise as any other; an empty table gives an empty result; extra columns are ignored;
texts of any length are one row, one that is larger than a shard's limit makes its shard that large.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from joblens.llm.common import numbered, saved, table, text_of

SHARDS = 8
VIRTUAL = 128
SLACK = 0.002
#: Turns of a size class; rows are at most 2 ** 63 long.
TURNS = 1 << 10
CLASSES = 63
RING = 1 << 14
CHUNK = 1 << 16


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard), by place. A shard's points do not depend on how many shards there are."""
    points = {}
    for shard in range(shards):
        for copy in range(virtual):
            digest = hashlib.blake2b(f"{shard}:{copy}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest) % RING, shard)
    return sorted(points.items())


def owners(points: list[tuple[int, int]], passed: frozenset[int]) -> list[int]:
    """The shard of each arc (the places up to a point, after the last one the first again), if keys
    pass these shards by."""
    shards = [shard for _, shard in points]
    found, behind = [], next(shard for shard in shards if shard not in passed)
    for shard in reversed(shards):
        behind = behind if shard in passed else shard
        found.append(behind)
    return found[::-1]


def looked_up(values: list[int], place: str) -> Column:
    """An entry of a constant array."""
    listed = F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    return F.element_at(listed, F.col(place).cast("int") + 1)


def arcs(points: list[tuple[int, int]]) -> list[int]:
    """The arc of each place of the ring."""
    found, place = [], 0
    for number, (point, _) in enumerate(points):
        found += [number] * (point + 1 - place)
        place = point + 1
    return found + [0] * (RING - place)


def of_shards(points: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """The same arcs, for the first so many shards only: points of others go to the next one."""
    own = owners(points, frozenset(shard for _, shard in points if shard >= shards))
    return [(place, shard) for (place, _), shard in zip(points, own)]


class Cells:
    """Stored sizes by (arc, turn). A class of them comes to the driver at a time, at most one row per
    arc and turn of a class, however large the table is."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.read: dict[int, tuple[np.ndarray, ...]] = {}

    def by_class(self, own: list[int], shards: int) -> dict[int, np.ndarray]:
        """Sizes per shard of each class that has any, the largest rows first."""
        number = F.floor(F.col("turn") / TURNS).cast("int").alias("class")
        sums = self.rows.groupBy(looked_up(own, "arc").alias("shard"), number).agg(F.sum("size").alias("size"))
        found: dict[int, np.ndarray] = {}
        for shard, number, size in sums.collect():
            found.setdefault(number, np.zeros(shards))[shard] += size
        return dict(sorted(found.items()))

    def of_class(self, number: int) -> tuple[np.ndarray, ...]:
        """(arc, turn, size), in the order of turns."""
        if number not in self.read:
            inside = (F.col("turn") >= number * TURNS) & (F.col("turn") < (number + 1) * TURNS)
            table = self.rows.where(inside).select("arc", "turn", "size").toArrow()
            arc, turn, size = (column.to_numpy() for column in table.columns)
            order = np.argsort(turn, kind="stable")
            self.read[number] = arc[order], turn[order], size[order]
        return self.read[number]


def bounded_loads(
    cells: Cells, points: list[tuple[int, int]], shards: int, slack: float = SLACK
) -> list[tuple[int, list[int]]]:
    """(turn from which it holds, the shard of each arc)."""
    nobody = owners(points, frozenset())
    sums = cells.by_class(nobody, shards)
    limit = sum(size.sum() for size in sums.values()) / shards * (1 + slack)
    loads, phases = np.zeros(shards), [(0, nobody)]
    for number, size in sums.items():
        if len(phases) == 1 and (loads + size <= limit).all():
            loads += size
        else:
            phases += class_phases(cells.of_class(number), number, loads, points, limit)
    return phases


def class_phases(cells, number: int, loads: np.ndarray, points, limit: float) -> list[tuple[int, list[int]]]:
    """The phases of one class; adds its rows to loads."""
    arc, turn, size = cells
    shards = len(loads)
    least = 2.0 ** (CLASSES - number)
    phases, since, passed, strict = [], number * TURNS, frozenset(), True
    while len(turn):
        if strict:
            passed |= {s for s in range(shards) if loads[s] + least > limit}
            strict = len(passed) < shards
        if not strict:
            passed = frozenset(s for s in range(shards) if loads[s] >= limit)
            if len(passed) == shards:  # by rounding only
                passed = frozenset()
        own = owners(points, passed)
        phases.append((since, own))
        shard = np.array(own)[arc]
        stop = (number + 1) * TURNS
        for s in range(shards):
            mine = shard == s
            load = loads[s] + np.cumsum(size[mine])
            # strictly, a turn that does not fit is not taken; else the one that reaches the limit is
            over = np.searchsorted(load, limit, "right" if strict else "left")
            if over < len(load):
                stop = min(stop, turn[mine][over] + (not strict))
        taken = turn < stop
        loads += np.bincount(shard[taken], size[taken], shards)
        if strict:
            sums = np.bincount(shard[turn == stop], size[turn == stop], shards)
            passed |= {s for s in range(shards) if sums[s] and loads[s] + sums[s] > limit}
        arc, turn, size, since = arc[~taken], turn[~taken], size[~taken], int(stop)
    return phases


def placed(phases: list[tuple[int, list[int]]]) -> Column:
    """The shard of rows (arc, turn)."""
    column = looked_up(phases[0][1], "arc")
    for since, own in phases[1:]:
        column = F.when(F.col("turn") < since, column).otherwise(looked_up(own, "arc"))
    return column


def with_turns(docs: DataFrame, points: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """Stored rows (uid, key, size, text_crc32, arc, turn)."""
    text = text_of(F.col("row.text"))
    name = F.col(f"row.{key}")
    size = (F.octet_length(text) + 1).cast("long")
    smaller = CLASSES + 1 - F.length(F.bin(size))
    rows = numbered(docs).select(
        "uid",
        name.alias("key"),
        size.alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(name, F.lit("place")), F.lit(RING)).alias("place"),
        (smaller * TURNS + F.pmod(F.xxhash64(name, "uid", F.lit("turn")), F.lit(TURNS))).alias("turn"),
    )
    rows = rows.withColumn("arc", looked_up(arcs(points), "place")).drop("place")
    return saved(rows, "sharding-rows")


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard without gaps; rows has uid, shard. A chunk holds the rows
    of one stretch of uids, so no window holds a whole shard."""
    chunk = F.floor(F.col("uid") / CHUNK)
    chunked = rows.withColumn("chunk", chunk)
    before = (
        chunked.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n"),
        )
        .drop("n")
    )
    place = F.row_number().over(Window.partitionBy("chunk", "shard").orderBy("uid"))
    numbered_rows = chunked.withColumn("within", place)
    return (
        numbered_rows.join(before, ["chunk", "shard"])
        .withColumn("slot", F.col("before") + F.col("within") - 1)
        .drop("chunk", "within", "before")
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK
) -> DataFrame:
    """(uid, key, size, text_crc32, shard, slot, moved_to): moved_to is the shard if there were
    one more."""
    points = ring(shards + 1, virtual)
    rows = with_turns(docs, points)
    cells = Cells(saved(rows.groupBy("arc", "turn").agg(F.sum("size").alias("size")), "sharding-cells"))
    now = placed(bounded_loads(cells, of_shards(points, shards), shards, slack))
    grown = placed(bounded_loads(cells, points, shards + 1, slack))
    dealt = rows.select(
        "uid", "key", "size", "text_crc32", now.alias("shard"), grown.alias("moved_to")
    )
    return with_slots(dealt)


def op2_bounded_load_ring(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast(T.IntegerType()).alias("shard"),
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        F.col("moved_to").cast(T.IntegerType()).alias("moved_to"),
    )
