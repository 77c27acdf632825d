"""Connected components by alternating large-star and small-star steps, each a few joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import made, settled, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Every node's chosen neighbours are linked to the least of them and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v), any comparable type without nulls. Returns (node, root) for every node of an edge; root is the
    least node of its component. Minima are partial aggregates and joins are skew joins, so a hub is no single task.
    """
    since = made()
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(seen) == mark or not seen["n"]:
            break
        mark = tuple(seen)
        now = settled(_star(_star(now, True), False), "edges", since)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
