"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabbro.llm.common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable by links (a, b), for every node that has one.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own
    label, so a path of n links needs about log n rounds. Minima are made before the shuffle; a node
    with very many links is a skewed join key, which Spark splits. Labels are written each round."""
    both = links.filter("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = low.join(jump, low["low"] == jump["at"], "left").select(
            "node", F.least("low", F.coalesce("further", "low")).alias("label"), (F.least("low", F.coalesce("further", "low")) != F.col("label")).alias("moved")
        )
        new = written(new, "labels")
        moved = new.filter("moved").limit(1).count()
        labels = new.select("node", "label")
        labels.written_to = new.written_to
        if not moved:
            return labels
    raise RuntimeError("components: labels still move")
