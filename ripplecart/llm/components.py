"""Connected components as Spark jobs: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import drop, saved


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns v, label: the smallest vertex reachable from each vertex of the links (two long columns, any order).

    Each round points every vertex at the smallest of its neighbours; a round costs two shuffles of the edges, and the
    number of rounds grows with the logarithm of the longest chain. Hubs are never collected: a vertex' neighbours
    meet its minimum in a join whose large partitions can be split. Vertices linked only to themselves are not listed.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = saved(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select("u", "v")  # u > v throughout
        small = down.join(_least(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(down).select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").distinct(), "edges")
        drop(edges)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(roots.select(F.col("label").alias("v"), "label"))
