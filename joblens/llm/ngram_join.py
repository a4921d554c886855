"""N-gram Jaccard join with a MinHash LSH forest.

Each text is the set of its five-word shingles. Texts with equal sets form one node. A node has
`TREES` sequences of `LONGEST` MinHash values; sorted, each is a prefix trie, and nodes meet where
they share a prefix. The prefix is shortened, from all values, until two texts at exactly the
threshold meet in some trie with the target probability. Nodes that meet form a component; its
nodes are verified against each other exactly, in blocks of bounded size, so candidates are never
listed as pairs, and what the forest misses within a component is found too.

Defined results: null text is empty; texts without words are equal to each other; a text of fewer
than five words is one shingle; equal texts are linked; repeated rows are members as any; null doc_ids are kept and sort last; an empty table gives an empty result; extra
columns are ignored; texts of any length are read whole.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblens.llm.common import numbered, partitions, saved, table, text_of
from joblens.llm.components import connected
from joblens.llm.shingles import shingle_hashes

SIMILAR = 0.8
TREES = 16
LONGEST = 8
TARGET_RECALL = 0.998
BLOCK = 400
SHINGLES_AT_ONCE = 4096
COLUMNS_AT_ONCE = 8192


def depth_for(similar: float, target: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which two texts of that similarity meet with the target probability."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - similar**depth) ** trees >= target:
            return depth
    return 1


def prefix_keys(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One key per trie: a hash of the first `depth` MinHash values of its sequence."""
    rng = np.random.default_rng(99)
    factors = rng.integers(1, 2**63, (trees, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, (trees, LONGEST), dtype=np.uint64)
    factors, shifts = factors[:, :depth].ravel(), shifts[:, :depth].ravel()
    least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        mixed = part[None, :] * factors[:, None]
        mixed += shifts[:, None]
        mixed >>= np.uint64(20)
        np.minimum(least, mixed.min(1), out=least)
    keys = np.zeros(trees, np.uint64)
    for column in least.reshape(trees, depth).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signed(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """Stored rows (uid, doc_id, node, keys): node is a 128-bit digest of the shingle set."""
    rows = numbered(docs).select(
        "uid", F.col("row.doc_id").cast("long").alias("doc_id"), text_of(F.col("row.text")).alias("text")
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, keys = [], []
                for text in part.column(2).to_pylist():
                    shingles = np.unique(shingle_hashes(text))
                    nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    met = len(shingles) > 0
                    keys.append(prefix_keys(shingles, trees, depth).tolist() if met else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(nodes, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["uid", "doc_id", "node", "keys"],
                )

    schema = "uid long, doc_id long, node binary, keys array<bigint>"
    return saved(rows.mapInArrow(sign, schema), "forest-signed")


def forest_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): every node and the least one with the same prefix in the same trie."""
    placed = nodes.select("uid", F.posexplode("keys").alias("tree", "key"))
    least = placed.groupBy("tree", "key").agg(F.min("uid").alias("least"), F.count("*").alias("n"))
    met = placed.join(least.where("n > 1"), ["tree", "key"])
    return met.where("uid <> least").select(F.col("least").alias("a"), F.col("uid").alias("b")).distinct()


def verified_links(groups: DataFrame, similar: float) -> DataFrame:
    """(uid, root, links): links counts the documents of the nodes that a node is similar to, in
    this pair of blocks; root is the least node it is connected with there.

    groups has component, one, two, uid, side, n, text: side is the block a node is from, and
    nodes are compared across if one and two differ."""

    def links(rows: list[tuple[int, int, int, str]], within: bool):
        sets = [np.unique(shingle_hashes(text)) for *_, text in rows]
        sizes = np.array([len(s) for s in sets])
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = counts > 1
        column = np.cumsum(shared) - 1
        keep = shared[inverse]
        owner, where = owner[keep], column[inverse[keep]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        for low in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
            a, b = np.searchsorted(where, [low, low + COLUMNS_AT_ONCE])
            width = min(COLUMNS_AT_ONCE, int(shared.sum()) - low)
            held = np.zeros((len(sets), width), np.float32)
            held[owner[a:b], where[a:b] - low] = 1
            common += held @ held.T
        union = sizes[:, None] + sizes[None, :] - common
        linked = common >= similar * union - 1e-9
        np.fill_diagonal(linked, False)
        sides = np.array([row[1] for row in rows])
        if not within:
            linked &= sides[:, None] != sides[None, :]
        weights = np.array([row[2] for row in rows], np.int64)
        label = np.arange(len(rows))
        while True:  # the least row that is reached
            lower = np.where(linked, label[None, :], len(rows)).min(1)
            new = np.minimum(label, lower)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return linked @ weights, label

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush():
            held.sort()
            counts, label = links(held, current[1] == current[2])
            some = np.flatnonzero(counts)
            uids = np.array([row[0] for row in held], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(uids[some]),
                    pa.array(uids[label[some]]),
                    pa.array(counts[some].astype(np.int64)),
                ],
                names=["uid", "root", "links"],
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != current:
                    if held:
                        yield flush()
                    current, held = row[:3], []
                held.append(row[3:])
        if held:
            yield flush()

    placed = groups.repartition(partitions(groups.sparkSession), "component", "one", "two")
    ordered = placed.sortWithinPartitions("component", "one", "two").select(
        "component", "one", "two", "uid", "side", "n", "text"
    )
    return ordered.mapInArrow(verify, "uid long, root long, links long")


def block_pairs(members: DataFrame) -> DataFrame:
    """(uid, n, component, one, two, side): a component of up to BLOCK nodes is one group; a larger
    one is cut into blocks, and each two of them are a group."""
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    dealt = members.join(sizes, "component").withColumn(
        "blocks", F.ceil(F.col("m") / BLOCK).cast("int")
    )
    side = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("component", "uid", "n", side.alias("side"), other).select(
        "component",
        F.least("side", "other").alias("one"),
        F.greatest("side", "other").alias("two"),
        "uid",
        "side",
        "n",
    )


def join_near(docs: DataFrame, similar: float = SIMILAR, target: float = TARGET_RECALL) -> DataFrame:
    """(uid, doc_id, class_id, links, copies, kept), a row per document: class_id is the least
    doc_id of the documents connected by links, links the number of other documents whose
    similarity is high enough, copies the number of documents with the same shingles, and kept
    holds for the first document of each class."""
    depth = depth_for(similar, target)
    rows = signed(docs, TREES, depth)
    by_id = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")
    nodes = saved(
        rows.groupBy("node").agg(
            F.min(by_id).alias("best"), F.count("*").alias("n"), F.min("uid").alias("uid")
        ),
        "forest-nodes",
    )
    edges = forest_edges(rows.join(nodes.select("uid"), "uid", "left_semi"))
    met = connected(edges).withColumnRenamed("label", "component")
    members = met.join(nodes.select("uid", "n"), met["v"] == nodes["uid"]).select(
        "uid", "n", "component"
    )
    groups = saved(block_pairs(members), "forest-groups")
    texts = numbered(docs).select("uid", text_of(F.col("row.text")).alias("text"))
    found = saved(verified_links(groups.join(texts, "uid"), similar), "forest-links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = connected(found.where("uid <> root").select(F.col("root").alias("a"), F.col("uid").alias("b")))
    joined = (
        nodes.join(links, "uid", "left")
        .join(roots.withColumnRenamed("v", "uid"), "uid", "left")
        .select(
            "node",
            "n",
            "best",
            F.coalesce("links", F.lit(0)).alias("others"),
            F.coalesce("label", "uid").alias("class"),
        )
    )
    first = joined.groupBy("class").agg(F.min("best").alias("first"))
    named = joined.join(first, "class").select("node", "n", "others", "first")
    return rows.select("uid", "doc_id", "node").join(named, "node").select(
        "uid",
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("others") + F.col("n") - 1).alias("links"),
        F.col("n").alias("copies"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
    )


def op10_lsh_forest_join(spark, sf_dir: str) -> DataFrame:
    return join_near(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "links", "copies", "kept"
    )
