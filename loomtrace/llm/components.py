"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_tasks, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; a component is named by its least node.

    Each round takes the least label of the neighbours and then the label of the label, so that chains halve; rounds are
    written tables, and the numbers of links and of labels still changing are all that the driver sees.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    rows = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    labels = written(few_tasks(labels, rows), "labels")
    while True:
        near = few_tasks(both.join(labels, both["b"] == labels["node"]).select("a", "component"), rows).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        jumped = few_tasks(lower, rows).join(up, "component").select("node", "old", F.least("component", "over").alias("component"))
        jumped = written(few_tasks(jumped, rows), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component < old").isEmpty():
            return labels
