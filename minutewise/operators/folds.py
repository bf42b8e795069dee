"""Day-level folds: (fold, split, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEST_SHARE = 0.3


def numbered(days: DataFrame) -> DataFrame:
    """day, i (from 0), n. A row a recorded day: one small window."""
    every = Window.orderBy("day")
    d = days.select("day").distinct()
    return d.withColumns({"i": F.row_number().over(every) - 1, "n": F.count("*").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")})


def chrono_folds(days: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """In day order: train, one validation day, then the latest share as test."""
    d = numbered(days).withColumn("first_test", F.col("n") - F.floor(F.lit(test_share) * F.col("n")).cast("int"))
    split = F.when(F.col("i") >= F.col("first_test"), "test").when(F.col("i") == F.col("first_test") - 1, "val").otherwise("train")
    return d.select(F.lit("chrono").alias("fold"), split.alias("split"), "day")


def cv_folds(days: DataFrame, size: int = 2) -> DataFrame:
    """Consecutive groups of days as test; the last remaining day as validation; all others as train."""
    d = numbered(days)
    folds = d.select(F.floor(F.col("i") / size).cast("int").alias("k")).distinct()
    pairs = d.crossJoin(F.broadcast(folds)).withColumn("is_test", F.floor(F.col("i") / size) == F.col("k"))
    last = F.max(F.when(~F.col("is_test"), F.col("i"))).over(Window.partitionBy("k"))
    split = F.when(F.col("is_test"), "test").when(F.col("i") == last, "val").otherwise("train")
    return pairs.select(F.concat(F.lit("cv"), F.col("k") + 1).alias("fold"), split.alias("split"), "day")
