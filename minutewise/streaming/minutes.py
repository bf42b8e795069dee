"""The minute grid over a stream: tumbling means with a watermark for late readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_minute_means(readings: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """readings (ts, component, kpi, value), streaming or not: minute, component, kpi, value, n."""
    means = readings.withWatermark("ts", late).groupBy(F.window("ts", width), "component", "kpi").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return means.select(F.col("window.start").alias("minute"), "component", "kpi", "value", "n")
