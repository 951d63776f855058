"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; rows leave as stars around the least id. Nothing is gathered on the driver
but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) for every id in an edge: root is the least id that it reaches; roots have a row too."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    last = None
    while True:
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(sums) == last:
            break
        last = tuple(sums)
        now = cut(_star(_star(now, True), False))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
