"""The exact time grid: bucketing, averaging, reindexing, reshaping. Long form throughout: (day, t, series, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of_second(second: Column, minutes_per_day: int, offset: int = 0, width: int = 1) -> Column:
    """Bucket of the day for an epoch second."""
    return F.floor(F.pmod(second + offset, F.lit(86400)) / (60 * width)).cast("int")


def bucket_of_time(ts: Column, width: int = 1) -> Column:
    """Bucket of the day for a timestamp without zone."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / width).cast("int")


def grid_mean(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Readings of one series in one bucket are averaged."""
    return readings.groupBy(*keys).agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def exact_grid(days: DataFrame, buckets: int) -> DataFrame:
    """day, t: every bucket of every day."""
    return days.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("t"))


def reindex(means: DataFrame, days: DataFrame, buckets: int, series: list[str]) -> DataFrame:
    """Every bucket of every series, null where nothing was read. The grid is made by explode, so only days x series cross."""
    cells = days.select("day").distinct().crossJoin(means.select(*series).distinct())
    grid = cells.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return grid.join(means.select("day", "t", *series, "value"), ["day", "t", *series], "left")


def widen(long: DataFrame, index: list[str], names: str, values: list, value: str, how=F.first) -> DataFrame:
    """A column for each of the stated values."""
    return long.groupBy(*index).pivot(names, values).agg(how(value))


def lengthen(wide: DataFrame, index: list[str], columns: list[str], names: str, value: str) -> DataFrame:
    return wide.unpivot(index, columns, names, value)
