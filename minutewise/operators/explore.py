"""Exploration around onsets: profiles, quiet times, close-ups, drift by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.functions.scalars import clip, draw, floor_div


def around(times: DataFrame, values: DataFrame, before: int, after: int) -> DataFrame:
    """times (id, day, t), values (day, t, series...): values at t - before .. t + after of the same day, with `minute` (relative).

    The times are spread over their rows, so the join is an equi-join.
    """
    asked = times.select("*", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("minute")).withColumn("_at", F.col("t") + F.col("minute")).drop("t")
    return asked.join(values.withColumnRenamed("t", "_at"), ["day", "_at"]).drop("_at")


def onset_profile(times: DataFrame, values: DataFrame, ids: list[str], series: list[str], before: int, after: int, base_to: int, bound: float = 10.0, value: str = "scaled") -> DataFrame:
    """ids, minute, change: mean over series of |value - baseline|, clipped; baseline: the series' median over [-before, -base_to]."""
    near = around(times, values, before, after)
    base = near.where(F.col("minute") <= -base_to).groupBy(*ids, *series).agg(F.percentile(value, F.lit(0.5)).alias("_base"))
    return near.join(base, [*ids, *series]).groupBy(*ids, "minute").agg(F.avg(clip(F.abs(F.col(value) - F.col("_base")), 0.0, bound)).alias("change"))


def by_spread(values: DataFrame, fit: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Adds `scaled` = value over the series' training range (q3 - q1); constant series are dropped."""
    return values.join(fit.where("moving").select(*series, "iqr"), series).withColumn("scaled", F.col(value) / F.col("iqr")).drop("iqr")


def whole_windows(times: DataFrame, buckets: int, before: int, after: int) -> DataFrame:
    return times.where((F.col("t") - before >= 0) & (F.col("t") + after <= buckets - 1))


def quiet_times(grid: DataFrame, onsets: DataFrame, distance: int, row: str = "row") -> DataFrame:
    """Rows farther than `distance` from every onset row. Rows are cut into stretches of that length, so only neighbouring stretches meet."""
    width = distance + 1
    near = onsets.select(F.col(row).alias("_o")).distinct().withColumn("_c", F.explode(F.array(*(floor_div(F.col("_o"), width) + d for d in (-1, 0, 1)))))
    cut = grid.withColumn("_c", floor_div(F.col(row), width))
    return cut.join(near, (cut["_c"] == near["_c"]) & (F.abs(cut[row] - near["_o"]) <= distance), "left_anti").drop("_c")


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows by the smallest hashes of key and seed: the sample is the operator's purpose."""
    return df.orderBy(draw(*(F.col(k) for k in key), seed), *key).limit(n)


def closeup(window: DataFrame, series: list[str], k: int = 4) -> DataFrame:
    """window (minute, series, value) of the faulty component: the k series that change most before the fault, scaled to 0..1.

    The history before the fault is cut in two at the middle of its minutes (rounded down); a series' contrast is the
    distance of the halves' means over its range in the whole window, 0 without a range or a half. Ties go by name.
    """
    first = window.agg(F.floor(F.min("minute") / 2).alias("_cut"))  # one number
    cut = window.join(F.broadcast(first), (F.col("minute") < 0) & (F.col("minute") >= F.col("_cut")), "left")
    late, early = F.col("_cut").isNotNull(), (F.col("minute") < 0) & F.col("_cut").isNull()
    half = cut.groupBy(*series).agg(
        F.min("value").alias("low"), (F.max("value") - F.min("value")).alias("range"), F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(late, F.col("value"))).alias("b")
    )
    contrast = F.when(F.col("range") > 0, F.coalesce(F.abs(F.col("b") - F.col("a")) / F.col("range"), F.lit(0.0))).otherwise(0.0)
    best = half.withColumn("contrast", contrast).orderBy(F.desc("contrast"), *series).limit(k)
    return window.join(F.broadcast(best.select(*series, "low", "range", "contrast")), series).withColumn("scaled", (F.col("value") - F.col("low")) / F.when(F.col("range") > 0, F.col("range")).otherwise(1.0))


def top_drift(train: DataFrame, series: list[str], k: int = 4) -> DataFrame:
    """The k series that tell the classes apart best on usable training rows (value, y), each series' days made level first."""
    from minutewise.operators.features import anova_f, demean, top_k

    return top_k(anova_f(demean(train, [*series, "day"]), series), k, series).select(*series)


def drift(values: DataFrame, fit: DataFrame, labels: DataFrame, folds: DataFrame, series: list[str]) -> DataFrame:
    """day, split, series, scaled_mean (all rows of the day), positive_rate (usable rows)."""
    means = values.groupBy("day", *series).agg(F.avg("value").alias("_m"))
    rates = labels.where("usable").groupBy("day").agg(F.avg(F.col("y").cast("double")).alias("positive_rate"))
    scaled = means.join(fit.select(*series, "median", "iqr"), series).withColumn("scaled_mean", (F.col("_m") - F.col("median")) / F.col("iqr"))
    return scaled.join(rates, "day", "left").join(folds.select("day", "split"), "day").select("day", "split", *series, "scaled_mean", "positive_rate")
