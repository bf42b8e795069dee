"""Train-only cleaning: which series to keep, how far to carry values forward, what to fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["component", "kpi"]


def missing_share(grid: DataFrame, series: list[str] = SERIES) -> DataFrame:
    return grid.groupBy(*series).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"))


def observed_every_day(grid: DataFrame, train_days: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Series with a value on each of the training days."""
    n_days = train_days.select("day").distinct().agg(F.count("*").alias("n_days"))
    days = grid.join(F.broadcast(train_days.select("day").distinct()), "day", "left_semi").groupBy(*series, "day").agg(F.count("value").alias("seen"))
    per_series = days.groupBy(*series).agg(F.count_if(F.col("seen") > 0).alias("days_seen"))
    return per_series.crossJoin(F.broadcast(n_days)).where("days_seen = n_days").select(*series)


def fill_limits(grid: DataFrame, series: list[str] = SERIES, factor: int = 2) -> DataFrame:
    """limit = max(factor, factor * int(median gap between values within a day)); a series without gaps has gap 1."""
    seen = grid.where("value is not null").withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*series, "day").orderBy("t")))
    gaps = seen.groupBy(*series).agg(F.median("gap").alias("gap"))
    return gaps.select(*series, F.coalesce("gap", F.lit(1.0)).alias("median_gap"), F.greatest(F.lit(factor), factor * F.floor(F.coalesce("gap", F.lit(1.0)))).cast("int").alias("limit"))


def bounded_ffill(grid: DataFrame, limits: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Adds `filled`: the last value of the same day, carried at most `limit` buckets."""
    day = Window.partitionBy(*series, "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.withColumns({"_v": F.last("value", ignorenulls=True).over(day), "_t": F.last(F.when(F.col("value").isNotNull(), F.col("t")), ignorenulls=True).over(day)})
    return held.join(limits.select(*series, "limit"), series, "left").withColumn("filled", F.when(F.col("t") - F.col("_t") <= F.col("limit"), F.col("_v"))).drop("_v", "_t", "limit")


def fill_rest(filled: DataFrame, train_days: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Adds `clean`: what is still missing takes the series' training median, or 0 if there is none."""
    medians = filled.join(F.broadcast(train_days.select("day").distinct()), "day", "left_semi").groupBy(*series).agg(F.median("filled").alias("_m"))
    return filled.join(medians, series, "left").withColumn("clean", F.coalesce("filled", "_m", F.lit(0.0))).drop("_m")


def prep_summary(grid: DataFrame, train_days: DataFrame, max_missing: float = 0.8, factor: int = 2, series: list[str] = SERIES) -> DataFrame:
    """One row: series at first, dropped by each rule, kept; residual missing shares after carrying values forward."""
    train = grid.join(F.broadcast(train_days.select("day").distinct()), "day", "left_semi")
    every = observed_every_day(grid, train_days, series).withColumn("_every", F.lit(True))
    share = missing_share(train, series)
    judged = share.join(every, series, "left").withColumn("_every", F.coalesce("_every", F.lit(False))).withColumn("_keep", F.col("_every") & (F.col("missing") <= max_missing))
    kept = judged.where("_keep").select(*series)
    filled = bounded_ffill(grid.join(kept, series, "left_semi"), fill_limits(train.join(kept, series, "left_semi"), series, factor), series)
    flagged = filled.join(F.broadcast(train_days.select("day").distinct().withColumn("_train", F.lit(True))), "day", "left")
    left = flagged.agg(F.avg(F.when(F.col("_train"), F.col("filled").isNull().cast("double"))).alias("missing_after_ffill_train"), F.avg(F.col("filled").isNull().cast("double")).alias("missing_after_ffill_all"))
    counts = judged.agg(
        F.count("*").alias("series_raw"),
        F.count_if(~F.col("_every")).alias("dropped_not_every_train_day"),
        F.count_if(F.col("_every") & (F.col("missing") > max_missing)).alias("dropped_over_80pct_missing"),
        F.count_if("_keep").alias("series_kept"),
    )
    return counts.crossJoin(left)


def kept_series(grid: DataFrame, train_days: DataFrame, max_missing: float = 0.8, series: list[str] = SERIES) -> DataFrame:
    """Series with a value on each training day and no more than `max_missing` of the training grid missing."""
    train = grid.join(F.broadcast(train_days.select("day").distinct()), "day", "left_semi")
    return missing_share(train, series).where(F.col("missing") <= max_missing).join(observed_every_day(grid, train_days, series), series, "left_semi").select(*series)


def cleaned(grid: DataFrame, train_days: DataFrame, max_missing: float = 0.8, factor: int = 2, series: list[str] = SERIES) -> DataFrame:
    """A fold's prepared grid: the kept series with `filled` (carried forward) and `clean` (the rest by training medians)."""
    rows = grid.join(F.broadcast(kept_series(grid, train_days, max_missing, series)), series, "left_semi")
    limits = fill_limits(rows.join(F.broadcast(train_days.select("day").distinct()), "day", "left_semi"), series, factor)
    return fill_rest(bounded_ffill(rows, limits, series), train_days, series)


def missingness(grid: DataFrame, train_days: DataFrame, max_missing: float = 0.8, factor: int = 2, series: list[str] = SERIES) -> DataFrame:
    """series, raw, after_cleaning: shares missing on the whole grid, before and after carrying forward; null where the series is dropped."""
    raw = missing_share(grid, series).withColumnRenamed("missing", "raw")
    after = cleaned(grid, train_days, max_missing, factor, series).groupBy(*series).agg(F.avg(F.col("filled").isNull().cast("double")).alias("after_cleaning"))
    return raw.join(after, series, "left")
