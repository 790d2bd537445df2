"""Connected components of a table of links."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import staged


def hung(links: DataFrame) -> DataFrame:
    """Links (a < b) of the same components: what is linked to a larger node hangs on the smallest of these instead.

    Nodes that are all linked with each other become a star. No link is added: each one gives at most one.
    """
    least = links.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("least"))
    moved = links.join(least, F.col("b") == F.col("_b")).select(F.col("least").alias("a"), F.col("a").alias("b")).where("a != b")
    return moved.union(least.select("least", "_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component for the ends of ``links`` (a, b): the component is its smallest node.

    Links are first hung on smallest nodes, while that spares a quarter of them: groups of near copies are linked many times over,
    and every round reads all links. In each round a node takes the smallest label around it, then its label's label, so that
    distances halve. Labels and links stay tables; whether any label moved is all that reaches the driver.
    """
    loops = links.where("a = b").select("a", "b")
    fewer = staged(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "hung")
    before, left = math.inf, fewer.count()
    while left and left <= 0.75 * before:
        fewer = staged(hung(fewer), "hung")
        before, left = left, fewer.count()
    both = staged(fewer.union(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(loops).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    while True:
        labels = staged(labels, "labels")
        around = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        own = labels.select("node", "component", F.col("component").alias("before"))
        lower = (
            own.unionByName(around, allowMissingColumns=True)
            .groupBy("node")
            .agg(F.min("component").alias("component"), F.min("before").alias("before"))
        )
        lower = staged(lower, "lower")
        if not lower.where("component != before").limit(1).count():
            return lower.select("node", "component")
        above = lower.select(F.col("node").alias("_label"), F.col("component").alias("_above"))
        labels = lower.join(above, F.col("component") == F.col("_label")).select(
            "node", F.least("component", "_above").alias("component")
        )
