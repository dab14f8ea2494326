"""Connected components of a graph whose links don't fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component): the least node of each node's component, for the nodes that have a link.

    Each round takes the least label among a node's neighbours and then the label of that label, so paths halve and the
    number of rounds follows the logarithm of the diameter. Sums are combined before the shuffle and labels are unique
    by node, so a hub of many links is only many rows of a join, which AQE splits. Every round ends in a checkpoint.
    Null ends are left out; repeated links and loops change nothing. Non-convergence is an error, never a wrong label.
    """
    one = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")))
    for _ in range(most_rounds):
        near = edges.join(labels, edges["u"] == labels["node"]).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("c"))
        least = labels.join(near, "node", "left").select("node", F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("j"))
        new = cut(least.join(jump, "component", "left").select("node", F.least("component", "j").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not converge in {most_rounds} rounds")
