"""Continuous intake: files land in a folder, each content is analysed once, findings are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import detectors
from assayer.sources.files import lenient_text

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def hourly(events: DataFrame, *, late: str | None = None) -> DataFrame:
    """Events by hour and type, of a table or a stream; a stream needs `late`, how long events may be late."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def arrivals(spark: SparkSession, folder: str, *, most: int = 100 << 20, late: str = "1 hour") -> DataFrame:
    """A stream of files of at most `most` bytes, each content once within the watermark."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)
    sized = files.filter((F.col("length") > 0) & (F.col("length") <= most)).withColumn("sha256", F.sha2("content", 256))
    return sized.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def analyse(arrived: DataFrame, out: str, checkpoint: str):
    """Starts a query that appends the findings of each arrived file to the Parquet folder `out`."""

    def each(batch: DataFrame, number: int) -> None:
        text = batch.select("path", lenient_text(F.col("content")).alias("content"))
        # A repeated batch overwrites its own folder.
        detectors.observations(text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
