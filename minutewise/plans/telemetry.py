"""The driver's tables as telemetry and fault record: 30-minute buckets, components of four users, errors as onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.operators.evaluate import thresholds
from minutewise.operators.folds import chrono_folds, cv_folds
from minutewise.operators.grid import bucket_of_time, exact_grid, grid_mean, reindex
from minutewise.operators.labels import label_and_mask

WIDTH, BUCKETS, LOOKBACK, HORIZON, BLACKOUT, FLOOR = 30, 48, 6, 3, 2, 150
SERIES = ["component", "kpi"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, components: int = 4) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.col("ts").cast("date").alias("day"), bucket_of_time(F.col("ts"), WIDTH).alias("t"), F.concat(F.lit("c"), F.col("user_id") % components).alias("component"), F.col("event_type").alias("kpi"), "value")


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") >= FLOOR))
    reason = F.concat(F.lit("r"), F.get_json_object("props", "$.k").cast("int") % 5)
    return e.select("event_id", "ts", F.col("ts").cast("date").alias("day"), bucket_of_time(F.col("ts"), WIDTH).alias("t"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("component"), reason.alias("reason"), "value")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()


def means(spark: SparkSession, sf_dir: str, components: int = 4) -> DataFrame:
    return grid_mean(readings(spark, sf_dir, components), ["day", "t", *SERIES])


def grid(spark: SparkSession, sf_dir: str, components: int = 4) -> DataFrame:
    return reindex(means(spark, sf_dir, components), days(spark, sf_dir), BUCKETS, SERIES)


def labels(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None) -> DataFrame:
    cells = exact_grid(days(spark, sf_dir), BUCKETS)
    return label_and_mask(cells, faults(spark, sf_dir).select("day", "t"), horizons or [HORIZON], BUCKETS, LOOKBACK - 1, BLACKOUT)


def chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chrono_folds(days(spark, sf_dir))


def cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_folds(days(spark, sf_dir))


def train_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chrono(spark, sf_dir).where("split = 'train'").select("day")


def predictions(spark: SparkSession, sf_dir: str, share: float = 0.1) -> DataFrame:
    """fold, day, t, row, y, score, threshold, alarm of usable test buckets: the score is the bucket's mean reading.

    A fold's threshold is cut from its validation scores, so that a share of these alarms.
    """
    score = readings(spark, sf_dir).groupBy("day", "t").agg(F.round(F.avg("value"), 9).alias("score"))
    usable = labels(spark, sf_dir).where("usable").join(cv(spark, sf_dir).where("split <> 'train'"), "day").join(score, ["day", "t"])
    cut = thresholds(usable.where("split = 'val'"), ["fold"], share).withColumn("threshold", F.round("threshold", 6))
    return usable.where("split = 'test'").join(cut, "fold").select("fold", "day", "t", row_of("day", "t").alias("row"), "y", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("alarm"))


def row_of(day: str, t: str):
    return F.unix_date(day).cast("long") * BUCKETS + F.col(t)


#: The same tables for DuckDB, as common table expressions.
SQL = """
rd AS (SELECT CAST(ts AS DATE) AS day, CAST((hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS t, 'c' || (user_id % 4) AS component, event_type AS kpi, value FROM events WHERE event_type <> 'error'),
fa AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST((hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS t, 'c' || (user_id % 4) AS component,
       'r' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS reason, value FROM events WHERE event_type = 'error' AND value >= 150),
mn AS (SELECT day, t, component, kpi, avg(value) AS value, count(value) AS n FROM rd GROUP BY ALL),
dy AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
bk AS (SELECT CAST(unnest(range(48)) AS INTEGER) AS t),
se AS (SELECT DISTINCT component, kpi FROM rd),
gr AS (SELECT day, t, component, kpi, value FROM dy CROSS JOIN bk CROSS JOIN se LEFT JOIN mn USING (day, t, component, kpi)),
ce AS (SELECT day, t, EXISTS (SELECT 1 FROM fa WHERE fa.day = dy.day AND fa.t = bk.t) AS is_onset FROM dy CROSS JOIN bk),
hz AS (SELECT unnest([1, 3, 6]) AS horizon),
la AS (SELECT c.day, c.t, h.horizon,
         CAST(EXISTS (SELECT 1 FROM fa WHERE fa.day = c.day AND fa.t > c.t AND fa.t <= c.t + h.horizon) AS INTEGER) AS y, c.is_onset,
         EXISTS (SELECT 1 FROM fa WHERE fa.day = c.day AND fa.t BETWEEN c.t - 2 AND c.t) AS dark
       FROM ce c CROSS JOIN hz h),
lb AS (SELECT day, t, horizon, y, is_onset, (t >= 5 AND t + horizon <= 47 AND (y = 1 OR NOT dark)) AS usable FROM la),
nd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dy),
ch AS (SELECT 'chrono' AS fold, CASE WHEN i >= n - CAST(floor(0.3 * n) AS INTEGER) THEN 'test' WHEN i = n - CAST(floor(0.3 * n) AS INTEGER) - 1 THEN 'val' ELSE 'train' END AS split, day FROM nd),
td AS (SELECT day FROM ch WHERE split = 'train'),
cp AS (SELECT k, day, i, i // 2 = k AS is_test, max(CASE WHEN i // 2 <> k THEN i END) OVER (PARTITION BY k) AS last FROM nd CROSS JOIN (SELECT DISTINCT i // 2 AS k FROM nd)),
cf AS (SELECT 'cv' || (k + 1) AS fold, CASE WHEN is_test THEN 'test' WHEN i = last THEN 'val' ELSE 'train' END AS split, day FROM cp),
sc AS (SELECT day, t, round(avg(value), 9) AS score FROM rd GROUP BY ALL),
uv AS (SELECT cf.fold, cf.split, l.day, l.t, l.y, s.score FROM lb l JOIN cf ON cf.day = l.day AND cf.split <> 'train' JOIN sc s ON s.day = l.day AND s.t = l.t WHERE l.horizon = 3 AND l.usable),
us AS (SELECT * EXCLUDE (split) FROM uv WHERE split = 'test'),
ct AS (SELECT fold, round(quantile_cont(score, 0.9), 6) AS threshold FROM uv WHERE split = 'val' GROUP BY fold),
pr AS (SELECT us.*, CAST(datediff('day', DATE '1970-01-01', us.day) AS BIGINT) * 48 + us.t AS row, threshold, score >= threshold AS alarm FROM us JOIN ct USING (fold))
"""
