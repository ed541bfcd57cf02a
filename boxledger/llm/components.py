"""Connected components of an edge table in rounds of small aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that links lead to.

    Each round hooks every node to the least label around it (pre-aggregated, so a hub is no hot task) and then jumps to
    its label's label; rounds end when no label changes, after about the logarithm of the longest chain.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        # A node also tells the node that it points to, so that trees hook onto each other at their roots.
        told = labels.join(heard, "id").select(F.col("component").alias("id"), "near").groupBy("id").agg(F.min("near").alias("told"))
        hooked = labels.join(heard, "id").join(told, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near", F.coalesce("told", "component")).alias("component"))
        jumped = hooked.alias("x").join(hooked.select(F.col("id").alias("up"), F.col("component").alias("top")), F.col("x.component") == F.col("up"))
        labels = cut(jumped.select("id", "old", F.least("component", "top").alias("component")))
        if labels.where("component <> old").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
