"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblens.llm.common import saved


def connected(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the least vertex of its component.

    Every round a vertex takes the least label among its neighbours, then that label's own label,
    so the distance to the least vertex falls quickly. State is written after each round."""
    both = saved(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "graph-edges"
    )
    labels = saved(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"),
        "graph-labels",
    )
    while True:
        offered = (
            both.join(labels, both["b"] == labels["v"])
            .groupBy("a")
            .agg(F.min("label").alias("offer"))
        )
        near = labels.join(offered, labels["v"] == offered["a"]).select(
            "v", "label", F.least("label", "offer").alias("next")
        )
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("beyond"))
        moved = saved(
            near.join(jump, "next").select("v", "label", F.least("next", "beyond").alias("next")),
            "graph-labels",
        )
        changed = moved.where("label <> next").limit(1).count()
        labels = moved.select("v", F.col("next").alias("label"))
        if not changed:
            return labels
