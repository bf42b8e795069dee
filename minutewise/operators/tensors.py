"""A fold's data as tensors: one array a day and series, per-fold scaling as a table, windows put together only in batches.

day_arrays() lays readings out on the day's exact grid, an array a (day, series). fold_fit() reads all days of one series
once and gives what every fold needs of it: whether it is kept, how far it is carried, what fills the rest, median and
IQR, and its F for each horizon, plain and within days. top_series() ranks series per model. fold_data() brings the chosen
series of one day together: a block, minutes x series, cleaned, scaled and clipped, with the minutes that are samples.
windows() slices a block's samples; no table holds a minute more than once a model.

A task holds the days of one series (fold_fit) or the chosen series of one day (fold_data): bounded by the recorded time
and by k, whatever the number of series, folds and horizons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.operators.labels import subsample_rows

SERIES = ["component", "kpi"]
MODEL = ["system", "inputs", "fold", "horizon"]
SPLITS = ("train", "val", "test")
BLOCK = [*MODEL, "split", "day", "series", "ts", "ys", "x"]


def day_arrays(means: DataFrame, days: DataFrame, buckets: int, keys: list[str], series: list[str] = SERIES) -> DataFrame:
    """keys, series, day, v: the values of each bucket (NaN where there is none), for every series on every day of `days` (keys, day)."""
    held = means.where(~F.isnan("value")).groupBy(*keys, *series, "day").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("value").cast("double")))).alias("_at"))
    every = means.select(*keys, *series).distinct().join(days.select(*keys, "day").distinct(), keys)
    nan = F.lit(float("nan"))
    at = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda t: F.coalesce(F.try_element_at("_at", t), nan))
    return every.join(held, [*keys, *series, "day"], "left").select(*keys, *series, "day", at.alias("v"))


def day_plan(folds: DataFrame, usable: DataFrame, horizons: list[int], buckets: int) -> DataFrame:
    """system, day, folds, splits (number in SPLITS, of each fold), labels (horizons x buckets: 1, 0, or -1 where not usable).

    folds: fold, split, day; usable: system, day, t, horizon, y."""
    split = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).cast("int") - 1
    dealt = folds.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("fold", split.alias("split")))).alias("_f"))
    marked = usable.groupBy("system", "day").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("horizon", "t").alias("k"), F.col("y").cast("int").alias("v")))).alias("_y"))

    def line(h: int):
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda t: F.coalesce(F.try_element_at("_y", F.struct(F.lit(h).alias("horizon"), t.alias("t"))), F.lit(-1)))

    cells = F.flatten(F.array(*map(line, horizons)))
    systems = usable.select("system").distinct()
    rows = dealt.join(F.broadcast(systems), F.lit(True)).join(marked, ["system", "day"], "left")  # a row a system and day
    return rows.select("system", "day", F.transform("_f", lambda s: s["fold"]).alias("folds"), F.transform("_f", lambda s: s["split"]).alias("splits"), cells.alias("labels"))


def two_class_f(x: np.ndarray, y: np.ndarray) -> float:
    """Between over within class variance; 0 without both classes or without spread within them, up to rounding."""
    n, p = len(y), int(y.sum())
    if n < 3 or p in (0, n):
        return 0.0
    x = x - x.mean()
    a, b = x[y == 1], x[y == 0]
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    between = p * a.mean() ** 2 + (n - p) * b.mean() ** 2
    return float(between / (within / (n - 2))) if within > 1e-14 * (x * x).sum() else 0.0


def carried(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's last value of its day, and how many buckets ago it was (a large number before the first)."""
    at = np.arange(x.shape[1])
    last = np.maximum.accumulate(np.where(np.isnan(x), -1, at), axis=1)
    return np.take_along_axis(x, np.maximum(last, 0), 1), np.where(last < 0, 1 << 30, at - last)


FIT = "fold string, missing double, every_day boolean, kept boolean, fill_limit int, fill double, median double, q1 double, q3 double, iqr double, left_train double, left_all double, f_level array<double>, f_change array<double>"


def fold_fit(arrays: DataFrame, plan: DataFrame, horizons: list[int], max_missing: float = 0.8, factor: int = 2) -> DataFrame:
    """system, component, kpi, fold and what the fold's training days tell of the series; F for each of `horizons`.

    Median and quartiles are exact over all minutes of the training days, cleaned; F is taken over their usable minutes.
    A day's own sorted positions, gaps and last values are worked out once for all folds."""
    columns = FIT.replace(" array<double>", "").replace(" double", "").replace(" boolean", "").replace(" string", "").replace(" int", "").split(", ")

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x = np.stack(pdf.v.to_numpy())
        labels = np.stack(pdf.labels.to_numpy()).reshape(len(x), len(horizons), -1)
        names = sorted({f for fs in pdf.folds for f in fs})
        # Folds need not deal every day: 3 stands for none.
        code = np.full((len(x), len(names)), 3)
        for i, (fs, ss) in enumerate(zip(pdf.folds, pdf.splits, strict=True)):
            code[i, [names.index(f) for f in fs]] = ss
        seen = ~np.isnan(x)
        gaps = [np.diff(np.flatnonzero(s)) for s in seen]
        value, age = carried(x)
        out = []
        for j, name in enumerate(names):
            tr = code[:, j] == 0
            if not tr.any():
                continue
            every, missing = bool(seen[tr].any(1).all()), float(1 - seen[tr].mean())
            gap = np.concatenate([g for g, t in zip(gaps, tr, strict=True) if t])
            limit = max(factor, factor * int(np.median(gap)) if len(gap) else factor)
            filled = np.where(age <= limit, value, np.nan)
            left = np.isnan(filled)
            known = filled[tr][~left[tr]]
            fill = float(np.median(known)) if len(known) else 0.0
            clean = np.where(left, fill, filled)
            q1, median, q3 = (float(q) for q in np.percentile(clean[tr], [25, 50, 75]))
            day = np.repeat(np.arange(len(x)), x.shape[1]).reshape(x.shape)
            f = [[], []]
            for h in range(len(horizons)):
                use = tr[:, None] & (labels[:, h] >= 0)
                v, y, d = clean[use], labels[:, h][use], day[use]
                n = np.bincount(d, minlength=len(x))
                within = v - (np.bincount(d, weights=v, minlength=len(x)) / np.maximum(n, 1))[d] if len(v) else v
                f[0].append(two_class_f(v, y))
                f[1].append(two_class_f(within, y))
            out.append((name, missing, every, every and missing <= max_missing, limit, fill, median, q1, q3, q3 - q1 if q3 - q1 > 1e-9 else 1.0, float(left[tr].mean()), float(left.mean()), *f))
        frame = pd.DataFrame(out, columns=columns)
        return frame.assign(system=key[0], component=key[1], kpi=key[2])[["system", *SERIES, *columns]]

    return arrays.join(plan, ["system", "day"]).groupBy("system", *SERIES).applyInPandas(fitted, f"system string, component string, kpi string, {FIT}")


def fold_prep(fit: DataFrame) -> DataFrame:
    """A row a system and fold: series at first, dropped by each rule, kept, and residual missing shares of the kept ones."""
    kept_only = lambda c: F.avg(F.when(F.col("kept"), F.col(c)))
    return fit.groupBy("system", "fold").agg(
        F.count("*").alias("series_raw"), F.count_if(~F.col("every_day")).alias("dropped_not_every_train_day"), F.count_if(F.col("every_day") & ~F.col("kept")).alias("dropped_over_80pct_missing"),
        F.count_if("kept").alias("series_kept"), kept_only("left_train").alias("missing_after_ffill_train"), kept_only("left_all").alias("missing_after_ffill_all"),
    )


def top_series(fit: DataFrame, horizons: list[int], k: int) -> DataFrame:
    """MODEL, rank, series and their fit: the k kept series of the largest F (level inputs: plain; change: within days), ties by name."""
    asked = F.array(*(F.struct(F.lit(i).alias("inputs"), F.lit(h).alias("horizon"), F.get(c, F.lit(n)).alias("f")) for i, c in (("level", "f_level"), ("change", "f_change")) for n, h in enumerate(horizons)))
    rows = fit.where("kept").select("system", *SERIES, "fold", "fill_limit", "fill", "median", "iqr", F.inline(asked))
    order = Window.partitionBy(*MODEL).orderBy(F.desc("f"), *SERIES)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def samples(usable: DataFrame, folds: DataFrame, seed: int, per_positive: int = 5, least: int = 500) -> DataFrame:
    """system, fold, horizon, split, day, ts, ys: the samples of each day in order; of training negatives the quota."""
    by = ["system", "fold", "horizon"]
    rows = usable.join(folds.select("fold", "split", "day"), "day").select(*by, "split", "day", "t", "y")
    used = subsample_rows(rows.where("split = 'train'"), by, ["day", "t"], seed, per_positive, least).unionByName(rows.where("split <> 'train'"))
    listed = used.groupBy(*by, "split", "day").agg(F.sort_array(F.collect_list(F.struct("t", F.col("y").cast("int").alias("y")))).alias("_s"))
    return listed.select(*by, "split", "day", F.transform("_s", lambda s: s["t"]).alias("ts"), F.transform("_s", lambda s: s["y"]).alias("ys"))


def fold_data(arrays: DataFrame, top: DataFrame, sampled: DataFrame, bound: float = 10.0) -> DataFrame:
    """BLOCK: a row a model and day: the chosen series' names, the samples' buckets and labels, and x, buckets x series in a row."""
    chosen = top.select(*MODEL, "rank", *SERIES, "fill_limit", "fill", "median", "iqr").join(arrays, ["system", *SERIES])
    held = F.struct("rank", F.concat_ws("||", *SERIES).alias("series"), "fill_limit", "fill", "median", "iqr", "v")
    rows = chosen.groupBy(*MODEL, "day").agg(F.sort_array(F.collect_list(held)).alias("_c")).join(sampled, ["system", "fold", "horizon", "day"])
    each = lambda c: F.transform("_c", lambda s: s[c]).alias(c)
    flat = rows.select(*MODEL, "split", "day", each("series"), "ts", "ys", each("fill_limit"), each("fill"), each("median"), each("iqr"), F.flatten(F.transform("_c", lambda s: s["v"])).alias("v"))

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for v, limit, fill, median, iqr in zip(pdf.v, pdf.fill_limit, pdf.fill, pdf["median"], pdf.iqr, strict=True):
                value, age = carried(np.reshape(v, (len(limit), -1)))
                clean = np.where(age <= np.asarray(limit)[:, None], value, np.asarray(fill)[:, None])
                out.append(np.clip((clean - np.asarray(median)[:, None]) / np.asarray(iqr)[:, None], -bound, bound).T.ravel())
            yield pdf.drop(columns="v").assign(x=out)[BLOCK]

    of = {f.name: f.dataType.simpleString() for f in flat.schema} | {"x": "array<double>"}
    return flat.mapInPandas(scaled, ", ".join(f"{c} {of[c]}" for c in BLOCK))


def block_windows(x: np.ndarray, ts: np.ndarray, k: int, lookback: int, change: bool = False, bound: float = 10.0) -> np.ndarray:
    """Samples x steps x series of a block. A window longer than the day so far starts with the day's first values.

    change: each window less its own median by series, clipped."""
    at = np.maximum(np.asarray(ts)[:, None] + np.arange(1 - lookback, 1), 0)
    w = np.reshape(x, (-1, k))[at]
    return np.clip(w - np.median(w, axis=1, keepdims=True), -bound, bound) if change else w


def window_rows(blocks: DataFrame, lookback: int) -> DataFrame:
    """MODEL, split, day, t, y, step (-(L-1)..0), series, value: windows spelled out, for looking at a few of them."""
    one = blocks.select(*MODEL, "split", "day", F.col("series").alias("_names"), "x", F.inline(F.arrays_zip(F.col("ts").alias("t"), F.col("ys").alias("y"))))
    step = one.withColumn("step", F.explode(F.sequence(F.lit(1 - lookback), F.lit(0))))
    cell = step.select(*MODEL, "split", "day", "t", "y", "step", F.posexplode("_names").alias("_j", "series"), "x", (F.greatest(F.lit(0), F.col("t") + F.col("step")) * F.size("_names")).alias("_at"))
    return cell.withColumn("value", F.get("x", (F.col("_at") + F.col("_j")).cast("int"))).drop("x", "_at", "_j")


def split_table(blocks: DataFrame, lookback: int, bound: float = 10.0) -> DataFrame:
    """MODEL, split: days, windows, positive, shape (n x L x k), and the share of inputs at the bounds, before they are made relative."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            at = [(np.abs(block_windows(x, ts, len(s), lookback)) >= bound).sum() for x, ts, s in zip(pdf.x, pdf.ts, pdf.series, strict=True)]
            yield pdf[[*MODEL, "split", "day"]].assign(k=pdf.series.map(len), n=pdf.ts.map(len), p=pdf.ys.map(sum), at=at)

    of = {f.name: f.dataType.simpleString() for f in blocks.schema}
    days = blocks.mapInPandas(counted, ", ".join(f"{c} {of[c]}" for c in [*MODEL, "split", "day"]) + ", k int, n long, p long, at long")
    return days.groupBy(*MODEL, "split").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ", ").alias("days"), F.sum("n").alias("windows"), F.sum("p").alias("positive"),
        F.concat_ws(" x ", F.sum("n"), F.lit(lookback), F.max("k")).alias("shape"), (F.sum("at") / F.sum(F.col("n") * F.col("k") * lookback)).alias("clipped_share"),
    )
