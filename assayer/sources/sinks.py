"""Writes by key: content-addressed puts, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored."""
    return rows.join(stored.select(*key), key, "left_anti")


def put_content(rows: DataFrame, path: str) -> None:
    """Appends rows (sha256, content, …) whose hash is not stored yet, in folders by the hash's first two digits."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    (new_rows(fresh, stored, ["sha256"]) if stored is not None else fresh).write.mode("append").partitionBy("shard").parquet(path)


def upserted(stored: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table after `changes`: one row a key, the one with the greatest version. A grouped maximum: partial results before the shuffle.

    A row without a version counts as the oldest; of equal versions a change wins over a stored row, then the row with the greater hash.
    """
    every = stored.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    others = [c for c in every.columns if c not in (*key, version, "_change")]
    hashed = [F.col(c).cast("string") if kind.startswith("map") else F.col(c) for c, kind in every.dtypes if c in others]
    order = F.struct(F.col(version).isNotNull(), version, "_change", F.xxhash64(F.lit(0), *hashed))
    best = every.groupBy(*key).agg(F.max_by(F.struct(version, *others), order).alias("_r"))
    return best.select(*key, "_r.*")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a line."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
