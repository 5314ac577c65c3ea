"""Connected components of links between ids, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condense.llm.blocks import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every id in links (a, b): label is the smallest id reachable.

    Each round takes the least label of the neighbours and then the label's own label, so the
    rounds grow with the logarithm of the longest path.  Labels are written to the shared folder
    after each round; only a count comes to the driver.  A hot label or node is a hot join key, not
    a group: partial minima and split joins deal with it.
    """
    both = materialized(links.select("a", "b").union(links.select("b", "a")).where("a <> b").toDF("a", "b").distinct())
    labels = materialized(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = materialized(labels.select("node", "label").join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialized(lower.join(target, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
