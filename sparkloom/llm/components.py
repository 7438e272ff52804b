"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which the labels must have settled; each at least halves the depth left.
MOST_ROUNDS = 60


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node reachable.

    Each round gives a node the least label among its neighbours' and then
    jumps to the label of that label, so that the number of rounds follows the
    logarithm of the longest chain.  Labels are written to a shared folder
    between rounds; a heavy node's links are summed before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, "links")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels-0")
    for i in range(1, MOST_ROUNDS + 1):
        old = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        low = both.join(old, "b").groupBy("a").agg(F.min("seen").alias("low")).select(F.col("a").alias("node"), "low")
        near = labels.join(low, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("mid"), F.col("label").alias("before"))
        # hook: the label's own node learns the lower label, then everyone jumps
        hook = near.groupBy(F.col("before").alias("node")).agg(F.min("mid").alias("hook"))
        near = scratch.save(near.join(hook, "node", "left").select("node", F.least("mid", F.coalesce("hook", "mid")).alias("mid"), "before"), f"hooked-{i}")
        jump = near.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        after = near.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "before")
        after = scratch.save(after, f"labels-{i}")
        labels = after.select("node", "label")
        if not after.filter("label <> before").head(1):
            return labels
        scratch.drop(f"hooked-{i}")
        scratch.drop(f"labels-{i - 1}")
    raise RuntimeError("component labels have not settled")
