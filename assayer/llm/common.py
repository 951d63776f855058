"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.arrays import let, running

__all__ = ["ROW_BY_ROW", "SPACES", "arrow_batches", "cut", "held_out", "let", "quantile", "running", "scratch", "small_batches", "table", "text_or_empty"]

#: Separators of words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


#: Options for writing rows of megabytes: a row group ends at 2 MB as stored. Without them the first look at its size comes after 100 rows, and readers take a whole group at once.
ROW_BY_ROW = {"parquet.block.size": str(2 << 20), **{f"parquet.{k}.size.row.check.{end}": "1" for k in ("block", "page") for end in ("min", "max")}}


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that run within send Python batches of about `size`, not 64 MB: an executor holds each several times for every task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, by whatever file system Spark resolves the path with."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is set a process of its own (tests) takes a new one; a cluster fails.

    What operators leave there (checkpoints, token files, stages) may be removed once their results are no longer read.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the checkpoint folder, so that later jobs and lost executors reread it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def quantile(values: DataFrame, share: float) -> DataFrame:
    """One row, one column `value`: what percentile() gives for the column `value`, null without any; a row counts `n` times, if there is such a column.

    Different values are counted, dealt by range and counted up within each range, so that no task holds more than a range of them.
    """
    counts = values.groupBy("value").agg((F.sum("n") if "n" in values.columns else F.count("*")).alias("n"))
    # Nulls leave behind the cut: a filter before it would be pushed down, and what makes the values computed twice.
    dealt = cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())).filter("value IS NOT NULL")
    # Ranges are as many as partitions: one row each.
    ranges = dealt.groupBy("part").agg(F.sum("n").alias("rows"))
    place = (F.sum("rows").over(Window.partitionBy()) - 1) * F.lit(float(share))
    ranges = ranges.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"), place.alias("place"))
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ranked = dealt.join(F.broadcast(ranges), "part").withColumn("upto", upto)
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= place) & (F.col("upto") > place), F.col("value")))
    ends = ranked.agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"), F.max(F.col("place") - F.floor("place")).alias("t"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("t")) * F.col("a") + F.col("t") * F.col("b"))
    return cut(ends.select(value.alias("value")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5: such rows are never learned from."""
    return F.crc32(F.col(name).cast("string")) % 5 == 0


def small_batches(batches, rows: int = 512, column: str | int | None = None, size: int = 1 << 20):
    """The same rows in smaller Arrow batches, so that what a task makes of a batch stays small too.

    At most `rows` rows each, and about `size` bytes of the text (or elements of the list) in `column`, if one is named; a longer row comes alone.
    """
    for batch in batches:
        ends = np.arange(batch.num_rows)
        if column is not None:
            cells = batch.column(column)
            lengths = pc.list_value_length(cells) if pa.types.is_list(cells.type) else pc.binary_length(cells)
            ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, before = 0, 0
        while i < batch.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right")))) if column is not None else i + rows
            yield batch.slice(i, j - i)
            i, before = j, int(ends[min(j, batch.num_rows) - 1])
