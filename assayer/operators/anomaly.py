"""Files whose capabilities differ from those of their directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import paths
from assayer.operators import patterns as P

MIN_PEERS, HIGH_SCORE = 3, 0.7


def eligible(path: Column) -> Column:
    """Whether a file is in a language that the capabilities describe."""
    return paths.extension(path).isin(*P.ANOMALY_EXTENSIONS)


def directory_anomalies(tags: DataFrame, *, min_peers: int = MIN_PEERS) -> DataFrame:
    """Score of each file that has a capability that is unusual in its directory.

    tags: directory, path, capability (distinct; a file without capabilities has one row with null). A capability is usual if
    max(2, a fifth of the peers, rounded down) files have it. Result: directory, path, score, n_unusual, n_capabilities, peers, severity. Every join
    is on grouped counts; AQE splits a large directory.
    """
    files = tags.groupBy("directory", "path").agg(F.count("capability").alias("n_capabilities"))
    peers = files.groupBy("directory").agg(F.count("*").alias("peers")).filter(F.col("peers") >= min_peers)
    counts = tags.filter("capability IS NOT NULL").groupBy("directory", "capability").agg(F.count("*").alias("n"))
    usual = counts.join(peers, "directory").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("peers") * F.lit(0.2).cast("double")))).select("directory", "capability")
    odd = tags.filter("capability IS NOT NULL").join(usual, ["directory", "capability"], "left_anti")
    found = odd.groupBy("directory", "path").agg(F.count("*").alias("n_unusual"))
    j = found.join(files, ["directory", "path"]).join(peers, "directory")
    j = j.withColumn("score", F.round(F.col("n_unusual") / F.col("n_capabilities"), 3))
    return j.withColumn("severity", F.when(F.col("score") >= HIGH_SCORE, "high").otherwise("medium"))
