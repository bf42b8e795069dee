"""Streams against the batch operators over the same rows, in several orders of arrival; sketches against exact quantiles."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutewise.operators import clean, evaluate, features, grid, rolling
from minutewise.streaming.features import run_to_table, stream_features

SERIES = ["component", "kpi"]
START = dt.datetime(2024, 3, 1)
SCHEMA = "ts timestamp, component string, kpi string, value double"
WIDTH, BUCKETS, LENGTH = 30, 48, 4


def made(seed):
    """Three days of readings, one series silent on the second day; values are quarters, so that sums are exact."""
    rng = random.Random(seed)
    rows = []
    for component, kpi in [("a", "x"), ("a", "y"), (None, "x")]:
        for _ in range(150):
            second = rng.randrange(3 * 86_400)
            if kpi == "y" and 86_400 <= second < 2 * 86_400:
                continue
            rows.append((START + dt.timedelta(seconds=second), component, kpi, rng.choice([None, float("nan"), *[rng.randrange(400) / 4] * 8])))
    # The end of the stream: a reading that closes the third day and opens a fourth.
    rows.append((START + dt.timedelta(days=3, hours=5), "end", "x", 1.0))
    return sorted(rows, key=lambda r: r[0])


def streamed(spark, rows, batches, folder, f):
    """f of a stream that brings the rows of each batch in a file of its own."""
    for i, at in enumerate(batches):
        spark.createDataFrame([rows[j] for j in at], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    return run_to_table(f(stream), f"{folder}/out")


def settings(spark):
    return spark.createDataFrame([("a", "x", 2, 10.0, 45.0), (None, "x", 3, 20.0, 40.0)], "component string, kpi string, limit int, fill double, threshold double")


def batch_rows(spark, rows):
    """The same by grid_mean, reindex, bounded_ffill, look_back and false_alarm_episodes."""
    r = spark.createDataFrame(rows, SCHEMA).where("component is null or component <> 'end'").fillna({"component": "null"})
    r = r.withColumns({"value": F.nullif("value", F.lit(float("nan"))), "day": F.to_date("ts"), "t": grid.bucket_of_time(F.col("ts"), WIDTH)})
    means = grid.grid_mean(r, ["day", "t", *SERIES])
    full = grid.reindex(means, r, BUCKETS, SERIES).join(r.select(*SERIES, "day").distinct(), [*SERIES, "day"], "left_semi")
    # Without settings a series carries nothing forward: the batch operator is told so by a limit of 0.
    absent = spark.createDataFrame([("a", "y", 0, 0.0, None)], settings(spark).schema)
    known = settings(spark).union(absent).fillna({"component": "null"})
    filled = clean.bounded_ffill(full, known, SERIES).join(known.select(*SERIES, "fill", "threshold"), SERIES, "left")
    filled = filled.withColumn("clean", F.coalesce("filled", "fill", F.lit(0.0)))
    windows = features.window_stats(features.look_back(filled, LENGTH, ["day", *SERIES], "clean")).select(*SERIES, "day", "t", F.col("mean").alias("score"))
    scored = filled.join(windows, [*SERIES, "day", "t"], "left").withColumn("alarm", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    starts = evaluate.false_alarm_episodes(scored.withColumns({"row": F.col("t"), "y": F.lit(0)}), ["day", *SERIES]).select(*SERIES, "day", "t", F.lit(True).alias("starts"))
    out = scored.join(starts, [*SERIES, "day", "t"], "left").fillna({"starts": False})
    return {(None if x["component"] == "null" else x["component"], x["kpi"], (x["day"] - dt.date(1970, 1, 1)).days, x["t"]): (x["value"], x["filled"], x["clean"], x["score"], x["alarm"], x["starts"]) for x in out.collect()}


def test_a_stream_equals_the_batch_operators_in_any_order_within_the_watermark(spark, tmp_path):
    rows = made(1)
    want = batch_rows(spark, rows)
    assert any(v[5] for v in want.values()) and any(v[1] is None for v in want.values())
    n = len(rows) - 1
    cuts = [range(0, n // 3), range(n // 3, 2 * n // 3), range(2 * n // 3, n), [n]]
    rng = random.Random(2)
    # Readings come up to six hours late: batches of an hour-wise jumbled order.
    jumbled = sorted(range(n), key=lambda j: rows[j][0] + dt.timedelta(hours=rng.uniform(0, 6)))
    orders = {"in_order": cuts, "jumbled": [*(jumbled[a : a + 90] for a in range(0, n, 90)), [n]], "at_once": [rng.sample(range(n + 1), n + 1)]}
    for name, batches in orders.items():
        out = streamed(spark, rows, batches, str(tmp_path / name), lambda s: stream_features(s, settings(spark), "6 hours" if name == "jumbled" else "1 hour", WIDTH, LENGTH))
        got = [x for x in out.collect() if x["component"] != "end"]
        told = {(x["component"], x["kpi"], x["day"], x["t"]): (x["value"], x["filled"], x["clean"], x["score"], x["alarm"], x["starts"]) for x in got}
        # On the day's last hours the stream's end reading must have closed everything, without a row twice.
        if name == "jumbled":  # the watermark ends six hours before the end reading: an hour before midnight
            last = max(k[2] for k in want)
            assert len(got) == len(told) and told.items() <= want.items() and {k for k in want if k[2] < last} <= told.keys()
        else:
            assert len(got) == len(told) and told == want, name


def test_late_readings_do_not_count_and_a_run_goes_on_where_it_ended(spark, tmp_path):
    at = lambda h, v, day=0: (START + dt.timedelta(days=day, hours=h), "a", "x", v)
    first, late, more = [at(1, 8.0), at(9, 2.0)], [at(1.1, 100.0), at(12, 4.0)], [at(2, 1.0, 1)]
    f = lambda s: stream_features(s, settings(spark), "1 hour", WIDTH, LENGTH)
    folder = str(tmp_path)
    out = streamed(spark, first, [[0, 1]], folder, f)
    assert {(r["t"], r["value"]) for r in out.where("value is not null").collect()} == {(2, 8.0)}
    for i, rows in enumerate([late, more], 1):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    rows = run_to_table(f(stream), f"{folder}/out").collect()
    # The first day is closed at midnight, each bucket once; what came too late is out.
    assert sorted(r["t"] for r in rows) == list(range(BUCKETS)) and {(r["t"], r["value"]) for r in rows if r["value"] is not None} == {(2, 8.0), (18, 2.0), (24, 4.0)}


def test_sketch_errors_stay_within_their_bound_and_expire(spark):
    rng = np.random.default_rng(5)
    values = {d: np.concatenate([rng.lognormal(0, 4, 400), -rng.lognormal(0, 3, 200), np.zeros(30)]) for d in range(6)}
    rows = [("k", START.date() + dt.timedelta(days=d), float(v)) for d, x in values.items() for v in x]
    rows += [("k", START.date(), None), ("k", START.date(), float("nan")), (None, START.date(), 7.0)]
    df = spark.createDataFrame(rows, "key string, day date, score double")
    for error, share in [(0.01, 0.1), (0.05, 0.5), (0.01, 0.95)]:
        sketches = rolling.day_sketch(df, ["key"], error=error)
        got = {(r["key"], (r["day"] - START.date()).days): r for r in rolling.rolling_thresholds(sketches, ["key"], 2, share, error).collect()}
        assert set(got) == {("k", d) for d in range(1, 7)} | {(None, 1)}
        for d in range(1, 7):
            pool = np.sort(np.concatenate([values[x] for x in range(max(0, d - 2), d)]))
            exact = pool[int(np.floor((1 - share) * (len(pool) - 1)))]
            r = got["k", d]
            assert r["n"] == len(pool) and r["n_days"] == min(d, 2) and abs(r["threshold"] - exact) <= error * abs(exact) * (1 + 1e-9) + rolling.FLOOR
        assert abs(got[None, 1]["threshold"] - 7) <= 7 * error
    # Merging counts of parts is the sketch of the whole; more rows make no more buckets.
    a, b = df.where("score > 1"), df.where("score <= 1")
    merged = rolling.day_sketch(a, ["key"]).union(rolling.day_sketch(b, ["key"])).groupBy("key", "day", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, rolling.day_sketch(df, ["key"]).collect()))
    tenfold = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_i")
    assert rolling.day_sketch(tenfold, ["key"]).count() == rolling.day_sketch(df, ["key"]).count()


def test_extreme_and_missing_scores_have_a_bucket(spark):
    df = spark.createDataFrame([(x,) for x in (-float("inf"), -1e300, -1e-12, 0.0, 1e-12, 1e-8, 1.0, 1e300, float("inf"))], "score double")
    got = df.select("score", rolling.bucket_of(F.col("score"), 0.01).alias("b")).orderBy("score").collect()
    numbers = [r["b"] for r in got]
    assert numbers == sorted(numbers) and [n for n in numbers if n == 0] == [0, 0, 0] and max(numbers) < 37_000
    with pytest.raises(ValueError, match="between 0 and 1"):
        rolling.gamma(1.0)
    empty = spark.createDataFrame([], "key string, day date, score double")
    assert rolling.rolling_thresholds(rolling.day_sketch(empty, ["key"]), ["key"]).count() == 0


def test_streamed_day_sketches_merge_to_the_batch_ones(spark, tmp_path):
    rows = made(3)
    order = random.Random(4).sample(range(len(rows) - 1), len(rows) - 1)
    out = streamed(spark, rows, [order[:200], order[200:], [len(rows) - 1]], str(tmp_path), lambda s: rolling.stream_day_sketch(s, SERIES, "value", 0.01, "4 days"))
    assert out.count() == 0  # nothing is closed within four days
    out = streamed(spark, rows, [range(len(rows))], str(tmp_path / "2"), lambda s: rolling.stream_day_sketch(s, SERIES, "value", 0.01, "1 hour"))
    want = rolling.day_sketch(spark.createDataFrame(rows[:-1], SCHEMA).withColumn("day", F.to_date("ts")), SERIES, "value")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.select(*SERIES, "day", "bucket", "n").collect()))
