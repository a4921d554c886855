"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks of documents. Targets come from weights, capped at a multiple of
a source's size. A source gives whole copies of itself and, for the rest of the target, blocks in a
permuted order that passes over each block that does not fit; large blocks are decided first. What
is then open is filled with single documents of the smallest blocks left, to the nearest document.
A source's quota is the number of blocks it gives. A binary tree splits the exact quotas
of all sources among the output shards: at each node the left half's share is drawn from the
multivariate hypergeometric distribution, as if all blocks were shuffled together. A shard then
takes the next stretch of each source's permuted blocks, so shards are disjoint, and orders its
documents by a hash. All draws come from hashes and fixed seeds, so reruns agree.

Defined results: null text has no words and is mixed with size 0; null is a source of its own and
sorts last; rows with equal doc_id and text share a block; an empty table, or one without words,
gives targets of 0; extra columns are ignored; texts of any length are counted whole.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblens.llm.common import numbered, partitions, saved, table, text_of

SHARDS = 8
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: A source has this many blocks, until they would hold more than BLOCK_ROWS documents.
BLOCKS = 1024
BLOCK_ROWS = 4096
#: A block with more than one in so many words of the rest is large.
LARGE = 32
#: So many blocks of a source, the smallest that do not fit, may be given in part.
IN_PART = 16
#: Sources are split in so many groups first, then the sources of a group.
GROUPS = 256
SEED = 17


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Stored rows (uid, doc_id, source, size, h)."""
    text = text_of(F.col("row.text"))
    rows = numbered(docs).select(
        "uid",
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").cast("string").alias("source"),
        words(text).alias("size"),
        F.xxhash64(F.col("row.doc_id"), text, F.lit(SEED)).alias("h"),
    )
    return saved(rows, "mixing-rows")


def targets(rows: DataFrame) -> DataFrame:
    """(source, sid, source_size, target, blocks), a row per source.

    Water filling: sources in the order in which a rising level, times their weight, meets their
    cap; the level at which the whole is shared out splits them into capped and open ones."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    named = sums.withColumn(
        "sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    )
    weight = F.element_at(F.lit(list(WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1)
    capped = named.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * F.lit(float(MOST_COPIES))
    )
    # a constant partition column: the window spans one row per source
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (
        F.sum("source_size").over(everything) * SHARE
        - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    levels = capped.withColumn("level", level)
    is_open = F.col("level") * F.col("weight") <= F.col("cap")
    # the first open source's level is the common one; later ones repeat it
    shared = F.min(F.when(is_open, F.struct(F.col("cap") / F.col("weight"), "sid", "level")))
    met = levels.withColumn("shared", shared.over(everything)["level"])
    target = F.when(F.col("shared") * F.col("weight") < F.col("cap"), F.col("shared") * F.col("weight"))
    per_block = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_ROWS)), F.col("n") / BLOCKS))
    return met.select(
        "source",
        F.col("sid").cast("long").alias("sid"),
        "source_size",
        F.coalesce(target, F.col("cap")).alias("target"),
        F.ceil(F.col("n") / per_block).alias("blocks"),
    )


def chosen_blocks(words: np.ndarray, draw: np.ndarray, rest: float) -> tuple[np.ndarray, float]:
    """(which blocks are given whole, what of the rest stays open). draw is uniform in [0, 1).

    A block with more than a LARGE-th of the rest, or without words, is decided first, with the
    chance that any block has. The others fill what is left, then the large ones not drawn."""
    total = words.sum()
    chance = rest / total if total > 0 else 1.0
    apart = (words > rest / LARGE) | (words == 0)
    drawn = apart & (draw < chance)
    stage = np.where(drawn, 0, np.where(apart, 2, 1))
    given = np.zeros(len(words), bool)
    # the draw that decides on large blocks is also the permuted order
    for at in np.lexsort((draw, stage)):
        if words[at] <= rest and (words[at] > 0 or drawn[at]):
            given[at] = True
            rest -= words[at]
    return given, rest


def chosen_documents(sizes: np.ndarray, counts: np.ndarray, rest: float) -> np.ndarray:
    """How many of counts[i] documents of sizes[i] words are given, in this order, passing over
    those that do not fit; then one more of the smallest left if that comes nearer."""
    given = np.zeros(len(sizes), np.int64)
    for at in np.flatnonzero(sizes > 0):
        given[at] = min(counts[at], int(rest // sizes[at]))
        rest -= given[at] * sizes[at]
    left = np.flatnonzero((given < counts) & (sizes > 0))
    if len(left):
        least = left[sizes[left].argmin()]
        if sizes[least] - rest < rest:
            given[least] += 1
    return given


def block_choices(dealt: DataFrame) -> DataFrame:
    """(sid, block, whole, given, open, turn): whole counts the block's copies that every document
    is in; given tells if the block is in the last, partial copy of its source. turn numbers the
    blocks that may fill the `open` words with some of their documents."""
    blocks = dealt.groupBy("sid", "block").agg(
        F.sum("size").alias("words"),
        F.first("target").alias("target"),
        F.first("source_size").alias("source_size"),
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    whole = F.least(F.coalesce(whole, F.lit(0)), F.lit(MOST_COPIES)).cast("int")
    draw = F.xxhash64("sid", "block", "whole", F.lit(SEED))
    blocks = blocks.withColumn("whole", whole).select(
        (F.col("sid") % GROUPS).alias("g"),
        "sid",
        "block",
        "whole",
        "words",
        (F.col("target") - F.col("whole") * F.col("source_size")).cast("double").alias("rest"),
        (F.pmod(draw, F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("draw"),
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.sort_values(["sid", "block"]).groupby("sid"):
            own = own.assign(given=False, open=0.0, turn=-1)
            if own["whole"].iloc[0] < MOST_COPIES:
                words, rest = own["words"].to_numpy(), float(own["rest"].iloc[0])
                own["given"], own["open"] = chosen_blocks(words, own["draw"].to_numpy(), rest)
                left = np.flatnonzero(~own["given"].to_numpy() & (words > 0))
                left = left[np.argsort(words[left], kind="stable")][:IN_PART]
                turn = np.full(len(own), -1)
                turn[left] = np.arange(len(left))
                own["turn"] = turn
            out.append(own)
        return pd.concat(out)[["sid", "block", "whole", "given", "open", "turn"]]

    schema = "sid long, block long, whole int, given boolean, open double, turn int"
    return saved(blocks.groupBy("g").applyInPandas(choose, schema), "mixing-choices")


def document_choices(dealt: DataFrame, choices: DataFrame) -> DataFrame:
    """(sid, block, h, size, some): how many of the equal documents of a block are given where
    not all are. Of one source, the documents of IN_PART blocks are looked at."""
    asked = choices.where((F.col("turn") >= 0) & (F.col("open") > 0)).select("sid", "block", "open", "turn")
    equal = (
        dealt.join(asked, ["sid", "block"])
        .groupBy("sid", "block", "h", "size", "open", "turn")
        .agg(F.count("*").alias("n"))
        .withColumn("g", F.col("sid") % GROUPS)
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.sort_values(["sid", "turn", "h", "size"]).groupby("sid"):
            sizes, counts = own["size"].to_numpy(), own["n"].to_numpy()
            given = chosen_documents(sizes, counts, float(own["open"].iloc[0]))
            out.append(own.assign(some=given)[given > 0])
        return pd.concat(out)[["sid", "block", "h", "size", "some"]]

    schema = "sid long, block long, h long, size long, some long"
    return saved(equal.groupBy("g").applyInPandas(choose, schema), "mixing-documents")


def block_quotas(choices: DataFrame, documents: DataFrame) -> DataFrame:
    """(sid, block, copies, ranks, in_part): how often a block is given, and each copy's place in
    the source's sequence of given blocks; in_part holds if its last copy is of some documents."""
    some = documents.select("sid", "block").distinct().withColumn("in_part", F.lit(True))
    met = choices.join(some, ["sid", "block"], "left").withColumn(
        "in_part", F.coalesce("in_part", F.lit(False))
    )
    met = met.withColumn("taken", F.col("given") | F.col("in_part"))

    def place(copy: Column | int, *within: str) -> Column:
        order = F.xxhash64("sid", "block", F.lit(copy) if isinstance(copy, int) else copy)
        return F.row_number().over(Window.partitionBy("sid", *within).orderBy(order, "block")) - 1

    ranked = met.withColumns(
        {
            "last": place(F.col("whole"), "taken"),
            "n": F.count("*").over(Window.partitionBy("sid")),
        }
        | {f"at{c}": place(c) for c in range(MOST_COPIES)}
    )
    ranks = F.array(*[F.col(f"at{c}") + F.col("n") * c for c in range(MOST_COPIES)])
    own = F.when(F.col("taken"), F.array(F.col("last") + F.col("n") * F.col("whole")))
    return ranked.select(
        "sid",
        "block",
        (F.col("whole") + F.col("taken").cast("int")).alias("copies"),
        F.concat(
            F.slice(ranks, F.lit(1), F.col("whole")),
            F.coalesce(own, F.array().cast("array<bigint>")),
        ).alias("ranks"),
        "in_part",
    )


def split_tree(
    quotas: np.ndarray, capacities: np.ndarray, rng: np.random.Generator
) -> np.ndarray:
    """Exact quotas (per colour) split among shards of exact capacity; both have the same sum."""
    out = np.zeros((len(quotas), len(capacities)), np.int64)

    def node(left: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = left
            return
        middle = (low + high) // 2
        drawn = rng.multivariate_hypergeometric(
            left, int(capacities[low:middle].sum()), method="marginals"
        )
        node(drawn, low, middle)
        node(left - drawn, middle, high)

    node(quotas.astype(np.int64), 0, len(capacities))
    return out


def shard_ends(quotas: DataFrame, shards: int) -> DataFrame:
    """(sid, ends): the first `ends[0]` taken blocks of a source go to shard 0, and so on."""
    grouped = quotas.withColumn("g", F.col("sid") % GROUPS)
    # at most GROUPS rows come to the driver, however many sources there are
    sums = sorted(grouped.groupBy("g").agg(F.sum("quota").alias("quota")).collect())
    of_group = np.array([row.quota for row in sums], np.int64)
    total = int(of_group.sum())
    even = np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)
    top = split_tree(of_group, even, np.random.default_rng(SEED))
    capacities = {row.g: top[i] for i, row in enumerate(sums)}

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        group = int(rows["g"].iloc[0])
        rng = np.random.default_rng([SEED, group])
        shares = split_tree(rows["quota"].to_numpy(), capacities[group], rng)
        return pd.DataFrame({"sid": rows["sid"].to_numpy(), "ends": list(shares.cumsum(1))})

    return grouped.groupBy("g").applyInPandas(split, "sid long, ends array<bigint>")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(uid, doc_id, h, size, source_size, target, shards): a row per document; `shards` names the
    shard of each of its copies in the mix."""
    rows = sized(docs)
    goals = saved(targets(rows), "mixing-targets")
    dealt = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select(
        "uid", "doc_id", "h", "size", "sid", "source_size", "target",
        F.pmod("h", "blocks").alias("block"),
    )
    choices = block_choices(dealt)
    documents = document_choices(dealt, choices)
    blocks = saved(block_quotas(choices, documents), "mixing-blocks")
    ends = shard_ends(blocks.groupBy("sid").agg(F.sum("copies").alias("quota")), shards)
    shard = lambda rank: F.size(F.filter("ends", lambda end: end <= rank))
    placed = blocks.join(ends, "sid").select(
        "sid", "block", "in_part", F.transform("ranks", shard).alias("shards")
    )
    met = dealt.join(placed, ["sid", "block"])
    columns = ["uid", "doc_id", "h", "size", "source_size", "target", "shards"]
    same = ["sid", "block", "h", "size"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("uid"))
    split = met.where("in_part").withColumn("nth", nth).join(documents, same, "left")
    without = F.slice("shards", F.lit(1), F.size("shards") - 1)
    kept = F.when(F.col("nth") <= F.col("some"), F.col("shards")).otherwise(without)
    return met.where(~F.col("in_part")).select(columns).union(
        split.withColumn("shards", kept).select(columns)
    )


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: docs with a row per copy, each shard's rows in a random order of its own."""
    placed = mix(docs, shards).where(F.size("shards") > 0).select("uid", "h", "shards")
    copies = (
        numbered(docs)
        .join(placed, "uid")
        .select("row", "uid", "h", F.posexplode("shards").alias("copy", "shard"))
    )
    order = F.xxhash64("h", "uid", "copy", "shard")
    parts = F.pmod(F.xxhash64("uid", "copy"), F.lit(max(1, partitions(docs.sparkSession) // shards)))
    return (
        copies.select("row", "shard", order.alias("order"), parts.alias("part"))
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "part", "order")
        .select("row.*")
    )


def op6_hypergeometric_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        "shards",
    )
