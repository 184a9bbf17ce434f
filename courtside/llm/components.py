"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.session import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node that has an edge to another.

    ``edges`` has columns a, b of one orderable type; loops, repeats and rows with a NULL are ignored. Each
    round moves every edge closer to the root of its component and is written to the shared
    folder, so neither lineage nor a lost executor makes earlier rounds run again; rounds grow with the
    logarithm of the longest chain. The minimum of a star is aggregated map-side before it is joined back.
    """
    edges = stage(edges.where("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stage(small.where("a > b").distinct(), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
