"""The driver's events as a stream: features of every series, day sketches and thresholds of the last days, beside their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.operators import clean, evaluate, rolling
from minutewise.operators.stage import new_folder
from minutewise.plans import telemetry as T
from minutewise.plans.catalog import GAPS, query, r6, train_grid
from minutewise.streaming.features import run_to_table, stream_features as features_of

LATE, SHARE, SPAN, ERROR = "10 minutes", 0.1, 5, 0.01
SERIES = T.SERIES


def stream_of(spark: SparkSession, sf: str) -> DataFrame:
    """ts, component, kpi, value of the events that are readings, as a stream of files."""
    # A stream of files takes a folder or a pattern; the pattern stands for the one path, be it a file or a folder.
    e = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet").where("event_type <> 'error'")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("component"), F.col("event_type").alias("kpi"), "value")


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """component, kpi, limit, fill, threshold from the training days: the carrying limit, and the median and upper tenth of the bucket means."""
    train = train_grid(spark, sf)
    cut = evaluate.quantiles(train, SERIES, "value", {"fill": 0.5, "threshold": 1 - SHARE})
    return clean.fill_limits(train).select(*SERIES, "limit").join(cut, SERIES).select(*SERIES, "limit", r6("fill").alias("fill"), r6("threshold").alias("threshold"))


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    rows = features_of(stream_of(spark, sf), settings(spark, sf), LATE, T.WIDTH, T.LOOKBACK)
    return run_to_table(rows, new_folder(spark, "stream")).withColumn("day", F.date_from_unix_date("day"))


CLOSED = "wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events WHERE event_type <> 'error')"
STREAMED = f"""{GAPS}, {CLOSED},
st AS (SELECT component, kpi, lim, round(quantile_cont(value, 0.5), 6) AS m, round(quantile_cont(value, 0.9), 6) AS threshold FROM gr JOIN td USING (day) JOIN lm USING (component, kpi) WHERE value IS NOT NULL GROUP BY ALL),
cl AS (SELECT mn.* FROM mn, wm WHERE CAST(day AS TIMESTAMP) + to_minutes((t + 1) * 30) <= w),
sd AS (SELECT component, kpi, day, unnest(range(0, 1 + CASE WHEN CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= any_value(w) THEN 47 ELSE max(t) END)) AS t FROM cl, wm GROUP BY component, kpi, day),
hs AS (SELECT component, kpi, day, t, value, last_value(value IGNORE NULLS) OVER o AS v, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER o AS seen_at FROM sd LEFT JOIN cl USING (component, kpi, day, t) WINDOW o AS (PARTITION BY component, kpi, day ORDER BY t ROWS UNBOUNDED PRECEDING)),
fs AS (SELECT h.*, threshold, CASE WHEN t - seen_at <= coalesce(lim, 0) THEN v END AS filled, coalesce(CASE WHEN t - seen_at <= coalesce(lim, 0) THEN v END, m, 0) AS clean FROM hs h LEFT JOIN st USING (component, kpi)),
ss AS (SELECT *, CASE WHEN t >= 5 THEN avg(clean) OVER (PARTITION BY component, kpi, day ORDER BY t ROWS 5 PRECEDING) END AS score FROM fs),
sa AS (SELECT *, coalesce(score >= threshold, false) AS alarm FROM ss),
sx AS (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY component, kpi, day ORDER BY t), false) AS starts FROM sa)"""


@query(f", {STREAMED} SELECT component, kpi, day, CAST(t AS INTEGER) AS t, round(value, 6) AS value, round(filled, 6) AS filled, round(clean, 6) AS clean, round(score, 6) AS score, alarm, starts FROM sx")
def stream_features(spark, sf):
    return streamed(spark, sf).withColumns({c: r6(c) for c in ("value", "filled", "clean", "score")})


@query(f", {STREAMED} SELECT component, kpi, day, count(*) FILTER (alarm) AS alarms, count(*) FILTER (starts) AS episodes, CAST(min(CASE WHEN starts THEN t END) AS INTEGER) AS first_start FROM sx GROUP BY ALL")
def stream_episodes(spark, sf):
    return streamed(spark, sf).groupBy(*SERIES, "day").agg(F.count_if("alarm").alias("alarms"), F.count_if("starts").alias("episodes"), F.min(F.when(F.col("starts"), F.col("t"))).alias("first_start"))


G, LOW = rolling.gamma(ERROR), rolling.lowest(ERROR)
BUCKET = f"CASE WHEN abs(s) > 1e-9 THEN CAST(sign(s) * (ceil(ln(abs(s)) / ln({G!r})) - ({LOW - 1})) AS BIGINT) ELSE 0 END"
#: Thresholds of the last days from counts sk (component, kpi, day, bucket, n).
ROLLED = f"""ru AS (SELECT component, kpi, CAST(day + k AS DATE) AS day, day AS of_day, bucket, n FROM (SELECT *, max(day) OVER (PARTITION BY component, kpi) AS last, CAST(unnest(range(1, {SPAN + 1})) AS INTEGER) AS k FROM sk) WHERE day + k <= last + 1),
mg AS (SELECT component, kpi, day, bucket, sum(sum(n)) OVER (PARTITION BY component, kpi, day ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY component, kpi, day) AS total FROM ru GROUP BY component, kpi, day, bucket),
th AS (SELECT component, kpi, day, min(bucket) FILTER (upto > floor({1 - SHARE} * (total - 1))) AS b, CAST(max(total) AS BIGINT) AS n FROM mg GROUP BY ALL),
tv AS (SELECT component, kpi, day, n, CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * pow({G!r}, abs(b) + ({LOW - 1})) * 2 / ({G!r} + 1) END AS threshold, n_days FROM th JOIN (SELECT component, kpi, day, count(DISTINCT of_day) AS n_days FROM ru GROUP BY ALL) USING (component, kpi, day))"""


@query(f", {CLOSED} SELECT component, kpi, day, bucket, count(*) AS n FROM (SELECT component, kpi, day, {BUCKET} AS bucket FROM (SELECT component, kpi, day, value AS s FROM rd, wm WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= w AND value IS NOT NULL)) GROUP BY ALL")
def stream_day_sketch(spark, sf):
    counts = rolling.stream_day_sketch(stream_of(spark, sf), SERIES, "value", ERROR, LATE)
    return run_to_table(counts, new_folder(spark, "sketch"))


def rolled(spark, sf):
    sketches = rolling.day_sketch(T.readings(spark, sf), SERIES, "value", ERROR)
    return rolling.rolling_thresholds(sketches, SERIES, SPAN, SHARE, ERROR)


COUNTS = f"sk AS (SELECT component, kpi, day, {BUCKET} AS bucket, count(*) AS n FROM (SELECT component, kpi, day, value AS s FROM rd WHERE value IS NOT NULL) GROUP BY ALL)"


@query(f", {COUNTS}, {ROLLED} SELECT component, kpi, day, round(threshold, 6) AS threshold, n, n_days FROM tv")
def rolling_thresholds(spark, sf):
    return rolled(spark, sf).withColumn("threshold", r6("threshold"))


@query(f", {COUNTS}, {ROLLED} SELECT component, kpi, day, count(*) AS readings, count(*) FILTER (value >= round(threshold, 6)) AS alarms FROM rd JOIN tv USING (component, kpi, day) GROUP BY ALL")
def rolling_alarms(spark, sf):
    told = T.readings(spark, sf).join(rolled(spark, sf).select(*SERIES, "day", r6("threshold").alias("threshold")), [*SERIES, "day"])
    return told.groupBy(*SERIES, "day").agg(F.count("*").alias("readings"), F.count_if(F.col("value") >= F.col("threshold")).alias("alarms"))
