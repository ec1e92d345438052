"""Connected components of a graph of links, by label propagation with pointer jumping.

Labels and links stay in tables; each round is written to the shared folder, so
lost executors cost one round. Only a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def components(links: DataFrame) -> DataFrame:
    """``links``: (a long, b long), any order, repeats and loops allowed. Returns (id, label): the smallest id it reaches.

    Every round takes, for each node, the smallest label among its neighbours, and
    then the label of that label, so paths shorten by half a round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = c.stash(both, "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label")
    labels = c.stash(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = c.stash(low.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("far", "low")).alias("label")), "labels")
        done = new.where("old <> label").limit(1).count() == 0
        labels = new.select("id", "label")
        if done:
            return labels
