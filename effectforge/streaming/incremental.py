"""Sufficient statistics of a stream of samples.

Sums of integers merge in any order, so a stream of sample-major rows keeps
exact running statistics; the batch form of the same query gives equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_allele_sums(panel: DataFrame) -> DataFrame:
    """marker_idx, n, sum_g over all rows so far; for ``complete`` or ``update`` sinks."""
    long = panel.select(F.posexplode("dosages").alias("marker_idx", "g"))
    return long.groupBy("marker_idx").agg(F.count("g").alias("n"), F.sum("g").cast("bigint").alias("sum_g"))


def windowed_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values of events by type and window, with a watermark."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean_value"
    )
