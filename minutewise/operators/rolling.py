"""Alarm thresholds from the last days, by a quantile sketch a day that can be merged and expires.

A sketch is a table of counts: scores whose size lies between two powers of g = (1 + error) / (1 - error) share a bucket.
Sketches of days, of parts of a day or of streams merge by adding counts, without loss and in any order; any rank's value
is known within `error` of its size (below FLOOR: within FLOOR). The number of buckets follows from the range of the
scores alone, not from their number: at an error of 0.01, 116 buckets for each factor of ten, 36,600 at most a sign.
A day's counts are sent to the days after it that use it, so a day expires by itself, and nothing is read again.

Defined results: null and NaN scores are left out; infinite ones are counted at the ends, as the largest finite ones; days without scores
add nothing; a day whose last days have no scores has no threshold (no row).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of this size or less count as 0.
FLOOR = 1e-9
#: Larger ones than this count as this.
CEILING = 1e308


def gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the error lies between 0 and 1")
    return (1 + error) / (1 - error)


def lowest(error: float) -> int:
    return math.ceil(math.log(FLOOR) / math.log(gamma(error)))


def bucket_of(score: Column, error: float) -> Column:
    """A number a bucket, in the order of the scores; 0 for 0."""
    size = F.least(F.abs(score), F.lit(CEILING))
    up = (F.ceil(F.log(size) / math.log(gamma(error))) - (lowest(error) - 1)).cast("long")
    return F.when(size > FLOOR, F.when(score > 0, up).otherwise(-up)).otherwise(F.lit(0).cast("long"))


def value_of(bucket: Column, error: float) -> Column:
    """The value within `error` of all scores of the bucket."""
    g = gamma(error)
    size = F.pow(F.lit(g), F.abs(bucket) + (lowest(error) - 1)) * (2 / (g + 1))
    return F.when(bucket == 0, 0.0).when(bucket > 0, size).otherwise(-size)


def day_sketch(scores: DataFrame, keys: list[str], score: str = "score", error: float = 0.01) -> DataFrame:
    """scores (keys, day, score), streaming or not: keys, day, bucket, n."""
    s = F.col(score).cast("double")
    return scores.where(s.isNotNull() & ~F.isnan(s)).groupBy(*keys, "day", bucket_of(s, error).alias("bucket")).agg(F.count("*").alias("n"))


def stream_day_sketch(scores: DataFrame, keys: list[str], score: str = "score", error: float = 0.01, late: str = "10 minutes") -> DataFrame:
    """scores (keys, ts, score), streaming: keys, day, bucket, n. A day's counts go on (append mode) once the watermark has closed it."""
    s = F.col(score).cast("double")
    known = scores.where(s.isNotNull() & ~F.isnan(s)).withWatermark("ts", late)
    counts = known.groupBy(F.window("ts", "1 day").alias("w"), *keys, bucket_of(s, error).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.to_date("w.start").alias("day"), "bucket", "n")


def rolling_thresholds(sketches: DataFrame, keys: list[str], span: int = 7, share: float = 30 / 1440, error: float = 0.01) -> DataFrame:
    """keys, day, threshold, n, n_days: for each day up to the one after the last, from the scores of the `span` days before it.

    The threshold stands for the score of rank floor((1 - share) * (n - 1)), from 0. `error`: that of the sketches.
    """
    last = sketches.groupBy(*keys).agg(F.max("day").alias("_last"))
    used = sketches.select(*keys, "bucket", "n", F.col("day").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(span))).alias("_k")).withColumn("day", F.date_add("_from", F.col("_k")))
    ends = last.select(*(F.col(k).alias(f"_e{k}") for k in keys), "_last")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e{k}"))
    used = used.join(ends, same).where(F.datediff("day", "_last") <= 1)
    merged = used.groupBy(*keys, "day", "bucket").agg(F.sum("n").alias("n"))
    days = used.groupBy(*keys, "day").agg(F.count_distinct("_from").alias("n_days"))
    of = Window.partitionBy(*keys, "day")  # buckets, not scores
    ranked = merged.withColumns({"_upto": F.sum("n").over(of.orderBy("bucket")), "_n": F.sum("n").over(of)})
    rank = F.floor(F.lit(1 - share) * (F.col("_n") - 1))
    found = ranked.groupBy(*keys, "day").agg(F.min(F.when(F.col("_upto") > rank, F.col("bucket"))).alias("_b"), F.max("_n").alias("n"))
    named = days.select(*(F.col(k).alias(f"_d{k}") for k in keys), F.col("day").alias("_dday"), "n_days")
    met = F.col("day") == F.col("_dday")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_d{k}"))
    return found.join(named, met).select(*keys, "day", value_of(F.col("_b"), error).alias("threshold"), "n", "n_days")
