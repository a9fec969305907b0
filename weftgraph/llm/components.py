"""Connected components of a table of links, by joins; nothing is gathered on the driver but a count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.store import dropped, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``links``.

    Each round takes the smallest label among neighbours, then the label of
    that label, so chains halve. Minima are pre-aggregated before the shuffle;
    a node with very many links only skews joins, which adaptive execution
    splits. Null ends and self-links add nothing.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node != other")
    both = written(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        step = written(step)
        of_next = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        moved = written(step.join(of_next, "next").select("node", F.col("component").alias("before"), F.least("next", "jump").alias("component")))
        changed = moved.where("before != component").limit(1).count()
        dropped(step)
        dropped(labels)
        labels = moved.drop("before")
        labels._weft_path = moved._weft_path
        if not changed:
            dropped(both)
            return labels
