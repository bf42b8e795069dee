"""Scaling, feature ranking, look-back windows and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.functions.scalars import array_median, clip
from minutewise.operators.evaluate import quantiles

SERIES = ["component", "kpi"]


def robust_fit(train: DataFrame, series: list[str] = SERIES, value: str = "value") -> DataFrame:
    """series, median, q1, q3, iqr (1 where it is no more than 1e-9). Exact percentiles, linear interpolation."""
    fit = quantiles(train, series, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return fit.select(*series, "median", "q1", "q3", F.when(iqr > 1e-9, iqr).otherwise(1.0).alias("iqr"), (iqr > 1e-9).alias("moving"))


def robust_scale(values: DataFrame, fit: DataFrame, series: list[str] = SERIES, value: str = "value", bound: float = 10.0) -> DataFrame:
    """Adds `scaled` = (value - median) / iqr, clipped."""
    joined = values.join(fit.select(*series, "median", "iqr"), series)
    return joined.withColumn("scaled", clip((F.col(value) - F.col("median")) / F.col("iqr"), -bound, bound)).drop("median", "iqr")


def demean(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Replaces the value by its distance from the mean of its keys (day and series): an aggregate and a join."""
    means = values.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return values.join(means, keys).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def anova_f(values: DataFrame, series: list[str] = SERIES, value: str = "value", label: str = "y") -> DataFrame:
    """series, f: between over within class variance for two classes. Values are centred by series first."""
    centred = demean(values.where(F.col(value).isNotNull()), series, value)
    x = F.col(value)
    m = centred.groupBy(*series, label).agg(F.count("*").alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"))
    square = F.col("_s") * F.col("_s") / F.col("_n")
    g = m.groupBy(*series).agg(F.sum("_n").alias("_n"), F.count("*").alias("_k"), F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss"), F.sum(square).alias("_b"))
    between, within = F.col("_b") - square, F.col("_ss") - F.col("_b")
    # As in the study, an infinite F (no spread within the classes, up to rounding) counts as 0, at any scale of the values.
    f = F.when((F.col("_k") == 2) & (F.col("_n") > 2) & (within > 1e-14 * F.col("_ss")), between / (within / (F.col("_n") - 2))).otherwise(0.0)
    return g.select(*series, f.alias("f"))


def top_k(scores: DataFrame, k: int, series: list[str] = SERIES, by: list[str] | None = None, score: str = "f", among: DataFrame | None = None) -> DataFrame:
    """The k series of the largest score (of each `by` group), ties by name, with their rank. among: only these series."""
    if among is not None:
        scores = scores.join(among.select(*series).distinct(), series, "left_semi")
    order = [F.desc(score), *series]
    if by:
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    best = scores.orderBy(*order).limit(k)  # keeps k rows a task, then k
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def look_back(values: DataFrame, length: int, keys: list[str], value: str, pad: bool = False) -> DataFrame:
    """Adds `window`: the last `length` values of the day, oldest first; with `pad`, short windows start with their first value."""
    day = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(length - 1), 0)
    out = values.withColumn("window", F.collect_list(F.struct(F.col(value).alias("v"))).over(day)).withColumn("window", F.transform("window", lambda s: s["v"]))
    if pad:
        return out.withColumn("window", F.concat(F.array_repeat(F.get("window", F.lit(0)), length - F.size("window")), F.col("window")))
    return out.where(F.size("window") == length)


def window_stats(windows: DataFrame, window: str = "window") -> DataFrame:
    """Adds last, mean, std (population), min, max, delta (last - first) of each window."""
    w = F.col(window)
    n = F.size(w)
    mean = F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / n
    out = windows.withColumn("mean", mean)
    spread = F.aggregate(w, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss")))
    return out.withColumns(
        {
            "last": F.element_at(w, -1),
            "std": F.sqrt(F.greatest(F.lit(0.0), spread["ss"] / n - (spread["s"] / n) * (spread["s"] / n))),
            "min": F.array_min(w),
            "max": F.array_max(w),
            "delta": F.element_at(w, -1) - F.get(w, F.lit(0)),
        }
    )


def change_inputs(windows: DataFrame, window: str = "window", bound: float = 10.0) -> DataFrame:
    """Each window less its own median, clipped."""
    out = windows.withColumn("_m", array_median(F.col(window)))
    return out.withColumn(window, F.transform(window, lambda x: clip(x - F.col("_m"), -bound, bound))).drop("_m")


def clipped_share(scaled: DataFrame, value: str = "scaled", bound: float = 10.0):
    return F.avg((F.abs(F.col(value)) >= bound).cast("double"))


def standardise(values: DataFrame, train: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns by their training mean and population deviation (1 where that is no more than 1e-9)."""
    fit = train.groupBy(*keys).agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns))
    out = values.join(fit, keys)
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 1e-9, F.col(f"{c}_s")).otherwise(1.0) for c in columns}).drop(*(f"{c}_{k}" for c in columns for k in "ms"))
