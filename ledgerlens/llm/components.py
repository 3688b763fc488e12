"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


#: Edges of a node that make it a hub, if they are not less than this share of all, which bounds the hubs to its double.
HUB_EDGES, HUB_SHARE = 100, 5_000


def _told(rows: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """Rows (a, b) with m, the smallest neighbour of a. Rows of hubs stay where they are: the few hubs are sent to them."""
    hubs = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    others = rows.join(F.broadcast(hubs.select("u")), F.col("a") == F.col("u"), "left_anti")
    return rows.join(hubs, F.col("a") == F.col("u")).select("a", "b", "m").union(others.join(least.where(F.col("n") <= bound), F.col("a") == F.col("u")).select("a", "b", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): each node that has an edge, and the smallest node it can reach.

    Every round points a node's larger neighbours at its smallest one, then the node itself, as the
    large-star and small-star steps do; rounds grow with the logarithm of the longest path. The rows of
    a hub are aggregated where they are, and joined by sending the hubs, of which there are at most
    2 * `HUB_SHARE`, to them. Each round is checkpointed.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _state(edges)
    while True:
        bound = max(HUB_EDGES, before[0] // HUB_SHARE)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = _told(both.where("b > a"), least, bound).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "u")
        joined = _told(large, down, bound)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
