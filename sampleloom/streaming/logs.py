"""Structured Streaming over append-only logs: first delivery per id, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Each key once, within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, group: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window and group."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), group, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is there through the stream into a parquet table and stop; in complete mode each batch replaces the table."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":  # the file sink can only append
        out = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        out = out.format("parquet").option("path", path)
    out.start().awaitTermination()
