"""Labels and evaluation masks from onsets, by bounded window frames within a day (no range join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.functions.scalars import draw


def label_and_mask(grid: DataFrame, onsets: DataFrame, horizons: list[int], buckets: int, first: int = 59, blackout: int = 10, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """grid (keys, t), onsets (keys, t): keys, t, horizon, y, is_onset, usable.

    y: an onset in (t, t + horizon]. Usable: t >= first, t + horizon within the day, and positive or no onset in
    [t - blackout, t].
    """
    marked = grid.join(onsets.select(*keys, "t").distinct().withColumn("is_onset", F.lit(1)), [*keys, "t"], "left").fillna(0, ["is_onset"])
    day = Window.partitionBy(*keys).orderBy("t")
    after = [F.coalesce(F.max("is_onset").over(day.rowsBetween(1, h)), F.lit(0)).alias(f"y{h}") for h in horizons]
    marked = marked.select(*keys, "t", "is_onset", F.max("is_onset").over(day.rowsBetween(-blackout, 0)).alias("dark"), *after)
    long = marked.select(*keys, "t", "is_onset", "dark", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in horizons))))
    usable = (F.col("t") >= first) & (F.col("t") + F.col("horizon") <= buckets - 1) & ((F.col("y") == 1) | (F.col("dark") == 0))
    return long.select(*keys, "t", "horizon", "y", "is_onset", usable.alias("usable"))


def usable_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    return labels.groupBy(*by).agg(F.count_if("usable").alias("usable"), F.count_if(F.col("usable") & (F.col("y") == 1)).alias("positive"))


def subsample_quota(train: DataFrame, by: list[str], per_positive: int = 5, least: int = 500) -> DataFrame:
    """Positives, and negatives to keep: min(available, max(per_positive * positives, least))."""
    counts = train.groupBy(*by).agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("available"))
    return counts.withColumn("negative", F.least("available", F.greatest(per_positive * F.col("positive"), F.lit(least))))


def subsample_rows(train: DataFrame, by: list[str], key: list[str], seed: int, per_positive: int = 5, least: int = 500) -> DataFrame:
    """All positives, and the quota of negatives with the smallest hashes of key and seed.

    Hashes count in the order of their rest by the number of ranges, then of their size. The quota's hash is found among hash ranges first, so that no group is ranked in one task: rows below the range in
    which the quota ends are kept, and only that range is ranked.
    """
    ranges = 4096
    hashed = train.withColumn("_h", draw(*(F.col(k) for k in key), seed)).withColumn("_r", F.pmod("_h", F.lit(ranges)))
    quota = subsample_quota(train, by, per_positive, least).select(*by, "negative")
    spread = hashed.where("y = 0").groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(quota, by).where("_before < negative").select(*by, "_r", "_before", "negative")
    inside = hashed.where("y = 0").join(before, [*by, "_r"])
    rank = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", *key))
    kept = inside.withColumn("_k", rank).where(F.col("_before") + F.col("_k") <= F.col("negative"))
    return train.where("y = 1").unionByName(kept.select(*train.columns))
