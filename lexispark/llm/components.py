"""Connected components of a graph in DataFrames: distributed union-find by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.scratch import drop, spill


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with BIGINT columns ``u``, ``v``; rows with a null end or u = v are ignored.

    Returns one row (node, root) per node that has a link; root is the smallest node of its component. Every round
    writes its edges to the shared folder; the number of rounds is logarithmic in the longest path. Minima are combined
    on the map side and a hot node's rows are split by adaptive skew joins, so no node's links meet in one task.
    """
    e = spill(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = None
    while True:
        before, e = e, spill(_small_star(_large_star(e)), "edges")
        drop(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()[:2]
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
