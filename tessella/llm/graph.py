"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the least id that can be reached. Edges with a null end are left out, and so
    are vertices that have only an edge to themselves.

    The number of rounds grows with the logarithm of the longest path; each round's edges are kept in the checkpoint folder.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.col("u"), F.min("v").over(W.partitionBy("u")))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = F.min("v").over(W.partitionBy("u"))
        small = large.select("u", "v", least.alias("m"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = cut(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
