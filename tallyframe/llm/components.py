"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is its smallest reachable node.

    Each round gives a node the smallest label among its own, its neighbours'
    and its label's label, so chains shorten by half. Labels are written to the
    shared folder after every round; only a count of changes reaches the driver.
    A hub with many edges is aggregated before the shuffle. Rows with a null
    end or a == b give no edge; an empty table has no nodes.
    """
    both = edges.where("a <> b").select("a", "b")
    both = stored(both.union(both.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = stored(labels.select("node", F.least("node", "low").alias("comp")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a").agg(F.min("comp").alias("near"))
        )
        stepped = labels.join(near, labels.node == near.a).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        above = labels.select(F.col("node").alias("parent"), F.col("comp").alias("grand"))
        nextone = stepped.join(above, stepped.comp == above.parent, "left").select(
            "node", "old", F.coalesce(F.least("comp", "grand"), "comp").alias("comp")
        )
        nextone = stored(nextone, "labels")
        changed = nextone.where("comp <> old").limit(1).count()
        labels = nextone.select("node", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
