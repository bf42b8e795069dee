"""Cleaned values, look-back means and alarm episodes of every series of a stream, bucket by bucket.

Readings become bucket means under a watermark; a bucket goes on once, when the watermark has closed it, so the second
step sees a series' buckets in order whatever order the readings came in. That step keeps one small state a series for
its open day: the last value for carrying forward, a ring of the last cleaned values, and whether an alarm is on. Nothing
crosses midnight, so a day is closed (its last buckets are sent on) by an event-time timer at midnight, and the state
goes. The rows equal those of grid_mean, reindex, bounded_ffill, look_back and false_alarm_episodes over the same readings.

Defined results: readings later than the watermark don't count; a series has rows in days in which it has a closed
bucket, and of a day still open up to its last closed bucket; null and NaN means are missing values; a series without
settings carries nothing forward, fills with 0 and raises no alarm; series whose names are null are series of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

DAY = 86_400
#: The state store that this kind of operator needs; run_to_table() sets it.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "day int, t int, seen double, seen_t int, ring array<double>, alarm boolean, reach int, fill double, threshold double"
ROWS = "component string, kpi string, day int, t int, value double, filled double, clean double, score double, alarm boolean, starts boolean"


class OpenDay:
    """One series' day so far. seen: the last value, of bucket seen_t; reach: how many buckets it may be carried."""

    def __init__(self, day: int, t: int, seen: float | None, seen_t: int, ring: list[float], alarm: bool, reach: int, fill: float, threshold: float | None):
        self.day, self.t, self.seen, self.seen_t, self.ring, self.alarm, self.reach, self.fill, self.threshold = day, t, seen, seen_t, list(ring), alarm, reach, fill, threshold

    def state(self) -> tuple[Any, ...]:
        return self.day, self.t, self.seen, self.seen_t, self.ring, self.alarm, self.reach, self.fill, self.threshold

    def upto(self, t: int, value: float | None, length: int) -> Iterator[tuple[Any, ...]]:
        """The rows of all buckets after the last one, up to t, where `value` was read."""
        for at in range(self.t + 1, t + 1):
            read = value if at == t else None
            if read is not None:
                self.seen, self.seen_t = read, at
            filled = self.seen if self.seen is not None and at - self.seen_t <= self.reach else None
            clean = self.fill if filled is None else filled
            self.ring = [*self.ring, clean][-length:]
            score = None
            if len(self.ring) == length:
                total = 0.0
                for x in self.ring:  # in order, as the batch operator adds them
                    total += x
                score = total / length
            alarm = score is not None and self.threshold is not None and score >= self.threshold
            yield self.day, at, read, filled, clean, score, alarm, alarm and not self.alarm
            self.alarm = alarm
        self.t = max(self.t, t)


def number(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


def stream_features(readings: DataFrame, settings: DataFrame, late: str = "10 minutes", width: int = 1, length: int = 60) -> DataFrame:
    """readings (ts, component, kpi, value), streaming; settings (component, kpi, limit, fill, threshold), a table.

    component, kpi, day (days since 1970), t (bucket of `width` minutes), value (the bucket's mean), filled (carried at
    most `limit` buckets), clean (else `fill`), score (the mean of the last `length` clean values of the day, null
    before), alarm (score >= threshold), starts (an alarm after none). To be written in append mode.
    """
    buckets = DAY // (60 * width)
    known = readings.select("ts", "component", "kpi", F.nullif(F.col("value").cast("double"), F.lit(float("nan"))).alias("value")).withWatermark("ts", late)
    means = known.groupBy(F.window("ts", f"{width} minutes").alias("w"), "component", "kpi").agg(F.avg("value").alias("value"))
    start = F.unix_timestamp(F.col("w.start"))
    placed = means.select(F.window_time("w").alias("closed"), F.floor(start / DAY).cast("int").alias("day"), F.floor(F.pmod(start, F.lit(DAY)) / (60 * width)).cast("int").alias("t"), "component", "kpi", "value")
    of = settings.select(F.col("component").alias("_c"), F.col("kpi").alias("_k"), F.col("limit").cast("int").alias("reach"), F.col("fill").cast("double").alias("fill"), F.col("threshold").cast("double").alias("threshold"))
    told = placed.join(of, F.col("component").eqNullSafe(F.col("_c")) & F.col("kpi").eqNullSafe(F.col("_k")), "left").drop("_c", "_k").fillna({"reach": 0, "fill": 0.0})

    return told.groupBy("component", "kpi").transformWithStateInPandas(Series(buckets, length), ROWS, "append", "eventTime")


class Series(StatefulProcessor):
    """One series of the stream: rows as its buckets close, and the rest of the day at midnight."""

    def __init__(self, buckets: int, length: int):
        self.buckets, self.length = buckets, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple[Any, ...]] = []
        day = OpenDay(*self.open.get()) if self.open.exists() else None
        before = day.day if day else None
        # One micro-batch's closed buckets of one series: a number a bucket.
        closed = pd.concat(list(rows)).sort_values(["day", "t"])
        for r in closed.itertuples(index=False):
            if day is not None and r.day > day.day:
                out += day.upto(self.buckets - 1, None, self.length)
                day = None
            if day is None:
                day = OpenDay(int(r.day), -1, None, 0, [], False, int(r.reach), float(r.fill), number(r.threshold))
            out += day.upto(int(r.t), number(r.value), self.length)
        if day is not None and timerValues.getCurrentWatermarkInMs() >= midnight(day.day):
            out += day.upto(self.buckets - 1, None, self.length)
            day = None
        if before is not None and (day is None or day.day != before):
            self.handle.deleteTimer(midnight(before))
        if day is None:
            self.open.clear()
        else:
            self.open.update(day.state())
            if day.day != before:
                self.handle.registerTimer(midnight(day.day))
        yield from frames(key, out)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            day = OpenDay(*self.open.get())
            self.open.clear()
            yield from frames(key, list(day.upto(self.buckets - 1, None, self.length)))


def midnight(day: int) -> int:
    """The end of the day in epoch milliseconds."""
    return (day + 1) * DAY * 1000


def frames(key: tuple[Any, ...], rows: list[tuple[Any, ...]]) -> Iterator[pd.DataFrame]:
    for part in itertools.batched(rows, 10_000):
        frame = pd.DataFrame(part, columns=["day", "t", "value", "filled", "clean", "score", "alarm", "starts"])
        frame.insert(0, "component", key[0])
        frame.insert(1, "kpi", key[1])
        yield frame.astype({"day": "int32", "t": "int32"} | dict.fromkeys(("value", "filled", "clean", "score"), "float64"))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Works off all input that is there, writes the result and the stream's checkpoint below the folder, and reads it back.

    A run over the same folder goes on where the last one ended.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
