"""Connected components and groups of equal rows as joins and aggregations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Each round, every tree hooks onto the smallest label beside it and labels jump to their label's label, so the rounds
    grow with the logarithm of the longest shortest path. Labels are written to the shared folder each round. The joins
    read plain staged tables on both sides, so that a hub's rows can be split by the skew join. Null ends are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = staged(links.union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        small = bounded(labels)
        near = edges.join(small.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").select(F.col("a").alias("node"), "other")
        offered = near.join(small, "node").where("other < component")
        hooked = offered.select("node", "other").union(offered.select(F.col("component").alias("node"), "other"))
        best = staged(hooked.groupBy("node").agg(F.min("other").alias("other")), "hooks")
        if best.isEmpty():
            return labels
        parents = staged(labels.join(bounded(best), "node", "left").select("node", F.least("component", "other").alias("component")), "parents")
        up = bounded(parents).select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = staged(parents.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")


def groups(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """`rows` (staged) with first_id, the smallest id of the rows equal in `keys`, and group_size.

    The counts are combined before the shuffle, and only groups of two or more rows are joined back, so a group that
    holds a third of all rows costs a row per task in the aggregation and is split by the skew join after it.
    """
    many = staged(rows.groupBy(*keys).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    joined = rows.join(bounded(many), keys, "left")
    return joined.withColumns({"first_id": F.coalesce("first_id", row_id), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
