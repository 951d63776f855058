"""Lineage of contents over archives: which roots hold a content, however deep, and what is found in it counts for each of them.

A content (by hash) can lie in many archives, and an archive in itself by a chain of others, so lineage is a graph, not a tree. Edges are (parent, child). Roots are the uploaded
contents. Each round joins the reached pairs (root, content) that are new with the edges and keeps those not reached before; it ends when none is new, after at most
`depth` rounds. A pair is written once, with its least depth; cycles end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import verdict
from assayer.sources.shared import stored

DEPTH = 32


def edges_of(unpacked: DataFrame) -> DataFrame:
    """(parent, child) of rows of archive.unpacked (content, parent_sha256)."""
    return unpacked.filter("parent_sha256 IS NOT NULL").select(F.col("parent_sha256").alias("parent"), F.sha2("content", 256).alias("child")).distinct()


def reached(roots: DataFrame, edges: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """(root, content, depth) of every content that a root holds, itself at depth 0, down to `depth`; the least depth of each pair.

    roots: root (repeated rows count once, nulls not); edges: parent, child (nulls lead nowhere).
    """
    links = stored(edges.filter("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").select("parent", "child").distinct())
    new = roots.filter("root IS NOT NULL").select("root", F.col("root").alias("content")).distinct()
    every = fresh = stored(new.withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        last = fresh.select("root", F.col("content").alias("parent"))
        step = last.join(links, "parent").select("root", F.col("child").alias("content")).distinct()
        fresh = stored(step.join(every.select("root", "content"), ["root", "content"], "left_anti").withColumn("depth", F.lit(d)))
        if fresh.isEmpty():
            break
        every = every.unionByName(fresh)
    return every


def rolled_up(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings (content, ...) once for every root that holds the content: root, depth and the columns of `found`."""
    return pairs.join(found, "content").select("root", "depth", *found.columns)


def root_verdicts(found: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """verdict.submission_verdicts of each root with the findings of all that it holds.

    found: content, severity, category; roots: submission (the root's hash), trusted, baseline_id, matched, distance, dynamic_gap.
    """
    return verdict.submission_verdicts(rolled_up(found, pairs).withColumnRenamed("root", "submission"), roots)
