"""Usage rollups over an unbounded log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(usage: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, tool, n, files): counts of a stream or table of usage rows by window and tool;
    rows later than ``late`` are closed."""
    x = usage.withWatermark("created_at", late) if usage.isStreaming else usage
    g = x.groupBy(F.window("created_at", window), "tool").agg(F.count("*").alias("n"), F.sum("file_count").cast("long").alias("files"))
    return g.select(F.col("window.start").alias("start"), "tool", "n", "files")


def start(usage: DataFrame, target: str, checkpoint: str, window: str = "1 day", late: str = "2 days"):
    """Append closed windows to a parquet folder."""
    return rollup(usage, window, late).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).start()
