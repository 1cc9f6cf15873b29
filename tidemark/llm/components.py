"""Connected components of an edge table, wholly distributed.

Labels start as the smallest neighbour; each round takes the least label among
the neighbours and then jumps to the label's own label, which halves the
depth of chains. Every round is written to the shared checkpoint folder, so
the lineage stays short and a lost executor costs one round at most; the round
before is deleted then. Only whether a label changed reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component. ``edges`` has long a, b.

    Self-loops and repeated edges are allowed; nodes without edges don't appear.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    old = labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        stepped = cut(moved.join(target, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), (F.least("next", F.coalesce("jump", "next")) < F.col("label")).alias("changed")))
        discard(old)
        old, labels = stepped, stepped.select("node", "label")
        if not stepped.where("changed").limit(1).count():
            discard(both)
            labels._cut_path = stepped._cut_path
            return labels
