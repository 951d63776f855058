"""Directory scans and text of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import paths
from assayer.operators import patterns as P

MOST_FILES, MOST_BYTES = 5000, 10 << 20


def walk(spark: SparkSession, root: str, *, most_files: int | None = MOST_FILES, most_bytes: int = MOST_BYTES, skip: tuple[str, ...] = P.SKIP_DIRS) -> DataFrame:
    """(path, length, content, sha256, class) of files below `root`, without skipped folders, empty and oversized files.

    Both size tests reach the source, so content of files left out is never read. most_files: the first by path, or None for all; they are
    picked by path alone, and only then is content read.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = source.filter((F.col("length") > 0) & (F.col("length") <= most_bytes))
    name = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = root.split("://")[-1].rstrip("/") + "/"
    local = F.when(name.contains(base), F.substring_index(name, base, -1)).otherwise(name)
    kept = found.withColumn("path", local).filter(~F.arrays_overlap(F.split(F.col("path"), "/"), F.array(*map(F.lit, skip))))
    if most_files:
        first = found.select("path").withColumn("local", local).filter(~F.arrays_overlap(F.split(F.col("local"), "/"), F.array(*map(F.lit, skip))))
        first = first.orderBy("local").limit(most_files).select("path")
        kept = found.join(F.broadcast(first), "path", "left_semi").withColumn("path", local).orderBy("path")  # at most `most_files` paths are broadcast
    return kept.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), paths.classify(F.col("path")).alias("class"))


def lenient_text(content: Column) -> Column:
    """UTF-8 text; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def strict_text(content: Column) -> Column:
    """UTF-8 text, null where the bytes are not."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def text(content: Column, known: Column) -> Column:
    """Text of bytes: with replacement characters where the file is known to be text, else null unless it is whole UTF-8."""
    return F.when(known, lenient_text(content)).otherwise(strict_text(content))
