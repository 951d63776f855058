"""Baselines: joins on product or signer, similarity of hash sets, and the nearest baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WEIGHT, FUNCTION_WEIGHT, MATCHED_BELOW, REGIONS = 0.6, 0.4, 0.2, 10
BROADCAST_ELEMENTS = 500_000


def candidates(artifacts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Pairs (artifact, baseline) with equal product or equal signer; empty strings match nothing.

    artifacts: artifact, product, signer; baselines: baseline, product, signer. Two hash joins, not a nested loop.
    """
    pairs = []
    for side in ("product", "signer"):
        a = artifacts.select("artifact", F.expr(f"nullif(CAST({side} AS string), '')").alias("k"))
        b = baselines.select("baseline", F.expr(f"nullif(CAST({side} AS string), '')").alias("k"))
        pairs.append(a.join(b, "k").select("artifact", "baseline"))
    return pairs[0].unionByName(pairs[1]).distinct()


def jaccard(a: Column, b: Column, empty: Column) -> Column:
    """Of two arrays as sets; `empty` where both have no element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def compare(pairs: DataFrame) -> DataFrame:
    """The nearest baseline of each artifact, the earliest of equally near ones.

    pairs: artifact, chunks, functions, baseline, ordinal, baseline_chunks, baseline_functions. Result: artifact, baseline, distance,
    matched, shared, new_regions, missing_regions.
    """
    chunk = jaccard(F.col("chunks"), F.col("baseline_chunks"), F.lit(1.0))
    j = pairs.withColumn("_chunk", chunk)
    both = jaccard(F.col("functions"), F.col("baseline_functions"), F.col("_chunk"))
    j = j.withColumn("distance", F.bround(1.0 - (F.col("_chunk") * CHUNK_WEIGHT + both * FUNCTION_WEIGHT), 4))
    first = lambda x, y: F.slice(F.array_sort(F.array_except(x, y)), 1, REGIONS)
    row = F.struct(
        "baseline",
        F.size(F.array_intersect("functions", "baseline_functions")).alias("shared"),
        first("functions", "baseline_functions").alias("new_regions"),
        first("baseline_functions", "functions").alias("missing_regions"),
    )
    best = j.groupBy("artifact").agg(F.min_by(row, F.struct("distance", "ordinal")).alias("b"), F.min("distance").alias("distance"))
    return best.select("artifact", "b.baseline", "distance", (F.col("distance") < MATCHED_BELOW).alias("matched"), "b.shared", "b.new_regions", "b.missing_regions")


def build(artifacts: DataFrame, functions: DataFrame) -> DataFrame:
    """Baseline rows: artifact columns with the sorted distinct hashes of its functions (artifact, normalized_hash)."""
    hashes = functions.groupBy("artifact").agg(F.array_sort(F.collect_set("normalized_hash")).alias("function_hashes"))
    return artifacts.join(hashes, "artifact", "left").withColumn("function_hashes", F.coalesce("function_hashes", F.array().cast("array<string>")))


def nearest_by_elements(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each id of `left` (id, elements) the `right` id whose element set is nearest in Jaccard distance, of those that share an element.

    An equi-join on elements and counts: what a nested comparison would find, without pairs that share nothing. Elements of `right` are
    broadcast while there are at most BROADCAST_ELEMENTS (counted); elements of `left` are then never shuffled, only counts of pairs, summed
    first. Ties go to the smallest right id. Ids without elements have no row. Result: id, nearest, distance.
    """
    sets = lambda rows, name: rows.select(F.col("id").alias(name), F.array_distinct("elements").alias("e"))
    b = sets(right, "other").select("other", F.size("e").alias("nb"), F.explode("e").alias("element"))
    a = sets(left, "id").select("id", F.size("e").alias("na"), F.explode("e").alias("element"))
    few = b.limit(BROADCAST_ELEMENTS + 1).count() <= BROADCAST_ELEMENTS
    j = a.join(F.broadcast(b) if few else b, "element").groupBy("id", "other", "na", "nb").agg(F.count("*").alias("n"))
    j = j.withColumn("distance", F.round(1.0 - F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6))
    return j.groupBy("id").agg(F.min_by("other", F.struct("distance", "other")).alias("nearest"), F.min("distance").alias("distance"))
