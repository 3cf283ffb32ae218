"""Run quality as a stream: failed and empty samples by window of time, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(diagnostics: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, samples, failed_samples, zero_ranked) of (ts, failed_sources, n_ranked); for batches and streams."""
    timed = diagnostics.withWatermark("ts", late) if diagnostics.isStreaming else diagnostics
    grouped = timed.groupBy(F.window("ts", window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("failed_sources") > 0).alias("failed_samples"), F.count_if(F.col("n_ranked") == 0).alias("zero_ranked")).select(F.col("w.start").alias("start"), "samples", "failed_samples", "zero_ranked")


def start(stream: DataFrame, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour"):
    """Writes closed windows to path; ends once what is there has been read."""
    return windowed_quality(stream, window, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
