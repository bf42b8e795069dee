"""Ranking metrics, thresholds, event detection, false alarms and bootstrap intervals, grouped by any keys.

No metric sorts a whole table in one task: scores are cut into ranges by approximate quantiles of each key, ranges are
summed first, and running sums inside a range start from the sum of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.operators.stage import kept

RANGES = 64  # a power of two
#: Tables of a few rows a key are broadcast if no more keys than these were counted: RANGES numbers each at most.
FEW_KEYS = 10_000


def by_score(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """keys, score, n, p (positives): ties collapsed."""
    return scores.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("p"))


def range_of(rows: DataFrame, score: str, to: str) -> DataFrame:
    """Replaces the column _cuts, RANGES - 1 ascending numbers, by how many of them are less than the score: halved step by step."""
    out = rows.withColumn(to, F.lit(0))
    half = RANGES // 2
    while half:
        out = out.withColumn(to, F.col(to) + F.when(F.get("_cuts", F.col(to) + (half - 1)) < F.col(score), half).otherwise(0))
        half //= 2
    return out.drop("_cuts")


def ranged(rows: DataFrame, keys: list[str], score: str = "score", to: str = "_r") -> DataFrame:
    """Adds the number of the row's range among `RANGES`, cut by approximate quantiles of the key."""
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    cut = rows.join(cuts, keys) if keys else rows.crossJoin(F.broadcast(cuts))
    return range_of(cut, score, to)


def running(ties: DataFrame, keys: list[str], score: str = "score", columns: tuple[str, ...] = ("n", "p"), descending: bool = True) -> DataFrame:
    """Adds c<column>: its sum over this score and all before it in order; t<column>: the key's total.

    Rows that bring their range along (ranged()) are not cut anew. Cut rows are written once: two plans read them, and
    approximate quantiles that are worked out twice need not be the same, which gave wrong sums.
    """
    cut = ties if "_r" in ties.columns else kept(ranged(ties, keys, score))
    order = F.desc("_r") if descending else F.asc("_r")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "_r").agg(*(F.sum(c).alias(f"_{c}") for c in columns))  # RANGES rows a key
    sums = sums.select(*keys, "_r", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in columns), *(F.sum(f"_{c}").over(whole).alias(f"t{c}") for c in columns))
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc(score) if descending else F.asc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(sums, [*keys, "_r"])
    return out.withColumns({f"c{c}": F.sum(c).over(inside) + F.col(f"_b{c}") for c in columns}).drop("_r", *(f"_b{c}" for c in columns))


def pr_auc(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """keys, pr_auc: sum over score steps of recall gained times precision; null without positives."""
    steps = running(by_score(scores, keys, score, y), keys, score)
    return steps.groupBy(*keys).agg(F.when(F.max("tp") > 0, F.sum(F.try_divide("p", "tp") * F.col("cp") / F.col("cn"))).alias("pr_auc"))


def roc_auc(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """keys, roc_auc by mean ranks; null if one class is missing."""
    steps = running(by_score(scores, keys, score, y), keys, score, descending=False)
    rank = F.col("cn") - (F.col("n") - 1) / 2
    p, n = F.max("tp"), F.max("tn")
    return steps.groupBy(*keys).agg(F.when((p > 0) & (p < n), (F.sum(rank * F.col("p")) - p * (p + 1) / 2) / (p * (n - p))).alias("roc_auc"))


def areas(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """keys, pr_auc, roc_auc: as pr_auc() and roc_auc() tell them, from the same running sums."""
    steps = running(by_score(scores, keys, score, y), keys, score)
    rank = F.col("tn") - F.col("cn") + (F.col("n") + 1) / 2  # counted from the lowest score
    p, n = F.max("tp"), F.max("tn")
    return steps.groupBy(*keys).agg(
        F.when(p > 0, F.sum(F.try_divide("p", "tp") * F.col("cp") / F.col("cn"))).alias("pr_auc"),
        F.when((p > 0) & (p < n), (F.sum(rank * F.col("p")) - p * (p + 1) / 2) / (p * (n - p))).alias("roc_auc"),
    )


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, and the exact quantile (linear interpolation) of each share, by name; nulls are left out.

    Each key's values are cut into ranges, the ranges are counted, and only the ranges in which a wanted rank lies are
    ranked: with no more than FEW_KEYS keys (counted) no other row is shuffled. The cuts are written before they are
    used, so that both readings of the rows cut alike.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = kept(known.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")))
    few = cuts.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    small = lambda table: F.broadcast(table) if few else table  # noqa: E731  # a few rows a key
    told = known.join(small(cuts), keys) if keys else known.crossJoin(F.broadcast(cuts))
    cut = range_of(told, "_v", "_r")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))  # RANGES rows a key
    sums = sums.select(*keys, "_r", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    places = {name: F.lit(float(share)) * (F.col("_total") - 1) for name, share in shares.items()}
    ranks = [f(place) for place in places.values() for f in (F.floor, F.ceil)]
    asked = reduce(or_, ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")) for r in ranks))
    wanted = sums.where(asked).select(*keys, "_r", "_before", "_total")
    ties = cut.join(small(wanted), [*keys, "_r"]).groupBy(*keys, "_r", "_before", "_total", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    steps = ties.withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v").cast("double")))
    found = {}
    for name, place in places.items():
        low, high = F.floor(place), F.ceil(place)
        found |= {f"_{name}_low": at(low), f"_{name}_high": at(high), f"_{name}_part": F.max(place - low)}
    ends = steps.groupBy(*keys).agg(*(c.alias(k) for k, c in found.items()))
    return small(ends.select(*keys, *((F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares)))


def thresholds(scores: DataFrame, keys: list[str], share: float = 30 / 1440, score: str = "score") -> DataFrame:
    """keys, threshold: the score's quantile at 1 - share, in the score's own type. Take it from validation scores."""
    kind = scores.schema[score].dataType
    return quantiles(scores, keys, score, {"threshold": 1 - share}).withColumn("threshold", F.col("threshold").cast(kind))


def confusion(scores: DataFrame, keys: list[str], y: str = "y", alarm: str = "alarm") -> DataFrame:
    """keys, tp, fp, fn, tn, precision, recall, f1, base_rate."""
    a, p = F.col(alarm), F.col(y) == 1
    c = scores.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fp"), F.count_if(~a & p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "base_rate": ratio(tp + fn, tp + fp + fn + tn)})


def located(onsets: DataFrame, grid: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """The onsets with the grid's row of their keys (such as day and bucket); reading an onset that the grid lacks is an error."""
    met = onsets.join(grid.select(*keys, F.col(row).alias("_row")), keys, "left")
    absent = F.raise_error(F.concat(F.lit("no grid row for the onset at "), F.concat_ws(" ", *keys))).cast("long")
    return met.withColumn(row, F.coalesce(F.col("_row"), absent)).drop("_row")


def event_detection(onsets: DataFrame, scores: DataFrame, keys: list[str], horizon: int | str, row: str = "row") -> DataFrame:
    """onsets (keys, row, ...), scores (keys, row, alarm): each onset with detected and lead (rows, earliest alarm in [row - horizon, row - 1]).

    horizon: a number, or a column of the onsets."""
    id_columns = onsets.columns
    upto = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    asked = onsets.select(*id_columns, F.explode(F.sequence(F.lit(1), upto)).alias("_k")).withColumn("_at", F.col(row) - F.col("_k"))
    alarms = scores.where("alarm").select(*keys, F.col(row).alias("_at"), F.lit(True).alias("_hit")).distinct()
    met = asked.join(alarms, [*keys, "_at"], "left")
    return met.groupBy(*id_columns).agg(F.max(F.when(F.col("_hit"), F.col("_k"))).alias("lead")).withColumn("detected", F.col("lead").isNotNull())


def event_summary(detected: DataFrame, keys: list[str]) -> DataFrame:
    return detected.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count_if("detected").alias("events_detected"), F.avg(F.col("detected").cast("double")).alias("event_recall"), F.median("lead").alias("median_lead")
    )


def false_alarm_episodes(scores: DataFrame, keys: list[str], row: str = "row", y: str = "y") -> DataFrame:
    """Starts of runs of alarmed negatives on adjacent usable rows. keys: what a sequence of rows belongs to.

    With the day among the keys no fold is sorted in one task; no run crosses midnight, as a day's last rows have no
    whole look-ahead and its first ones no whole window.
    """
    w = Window.partitionBy(*keys).orderBy(row)
    fa = F.col("alarm") & (F.col(y) == 0)
    marked = scores.withColumn("_fa", fa).withColumns({"_pf": F.lag("_fa").over(w), "_pr": F.lag(row).over(w)})
    follows = F.coalesce(F.col("_pf") & (F.col(row) - F.col("_pr") == 1), F.lit(False))
    return marked.where(F.col("_fa") & ~follows).drop("_fa", "_pf", "_pr")


def row_numbers(rows: DataFrame, keys: list[str], order: str, row: str = "i") -> tuple[DataFrame, DataFrame]:
    """The rows with their number from 0 in the order of `order` within each key, and the keys with n_rows.

    Numbers are running sums over ranges of `order`, so no key is sorted in one task.
    """
    numbered = running(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, ("_one",), descending=False)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return numbered.withColumn(row, F.col("c_one") - 1).drop("_one", "c_one", "t_one"), counts


#: Draws are taken modulo this prime (fixed value), so that products stay below 2**63 in any SQL engine.
PRIME = 2**31 - 1


def block_starts(n_rows: int, reps: int = 300, block: int = 60, seed: int = 20260916) -> np.ndarray:
    """reps x max(1, n_rows div block) starts below n_rows - block + 1, drawn from seed, repetition and block number.

    (The study draws below n_rows - block, so its last row is in no block.)"""
    rep, b = np.arange(reps)[:, None], np.arange(max(1, n_rows // block))[None, :]
    u = (rep * 40692 + b * 48271 + seed) % PRIME
    v = (u * u + 12345) % PRIME
    return (v * v + u) % PRIME % max(1, n_rows - block + 1)


def times_drawn(at: np.ndarray, n_rows: int, starts: np.ndarray, block: int) -> np.ndarray:
    """reps x rows: how many of a repetition's blocks the row numbers `at` lie in."""
    reps = len(starts)
    wide = n_rows + 2 * block
    shift = np.arange(reps)[:, None] * wide
    flat = (np.sort(starts, axis=1) + block + shift).ravel()
    upto = lambda i: np.searchsorted(flat, (i[None, :] + block + shift).ravel(), "right").reshape(reps, -1)
    return upto(at) - upto(at - block)


def block_bootstrap(scores: DataFrame, keys: list[str], n_rows: int | DataFrame, row: str = "i", reps: int = 300, block: int = 60, seed: int = 20260916, part: int = 4096) -> DataFrame:
    """keys, pr_auc_lo, pr_auc_hi: 2.5 and 97.5 percentiles of PR-AUC over block resamples of all rows 0..n_rows-1 of each key.

    n_rows: a number that all keys share, or a table keys, n_rows. No resampled row is ever made: a row's number of
    drawings follows from the sorted starts of a repetition's blocks. A key's scores are cut into ranges of about `part` rows
    (64 at most); each range gives its drawn rows and positives by repetition, prefix sums of these tell what stands above
    a range, and each range then adds its part of every repetition's area. Rows are shuffled as they are, and a range
    adds a few hundred numbers. Repetitions of one class only are left out, and a key of one class has null bounds.
    """
    counts = n_rows if isinstance(n_rows, DataFrame) else scores.select(*keys).distinct().withColumn("n_rows", F.lit(n_rows).cast("long"))
    cut = ranged(scores.select(*keys, F.col(row).cast("long").alias("_i"), F.col("score").cast("double").alias("score"), F.col("y").cast("long").alias("y")), keys)
    ranges = F.least(F.lit(RANGES), F.ceil(F.col("n_rows") / part)).cast("int")
    rows = kept(cut.join(counts, keys).withColumn("_r", F.floor(F.col("_r") * ranges / RANGES).cast("int")))
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"{k} {of[k]}" for k in keys)
    by = [*keys, "_r"]

    def drawn(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        """The rows' drawings, some repetitions at a time."""
        n = int(pdf.n_rows.iloc[0])
        starts, step = block_starts(n, reps, block, seed), max(1, 4_000_000 // len(pdf))
        for a in range(0, reps, step):
            yield times_drawn(pdf["_i"].to_numpy(), n, starts[a : a + step], block)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.y.to_numpy()
        n, p = zip(*((m.sum(1), m @ y) for m in drawn(pdf)), strict=True)
        return pdf[by].head(1).assign(n=[np.concatenate(n)], p=[np.concatenate(p)])

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r", ascending=False)
        n, p = np.stack(pdf.n.to_list()), np.stack(pdf.p.to_list())
        return pdf[by].assign(bn=list(np.cumsum(n, 0) - n), bp=list(np.cumsum(p, 0) - p), tn=[n.sum(0)] * len(pdf), tp=[p.sum(0)] * len(pdf))

    def areas(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(before):
            return pd.DataFrame(columns=[*keys, "ap"])
        pdf, b = pdf.sort_values("score", ascending=False), before.iloc[0]
        y, score = pdf.y.to_numpy(), pdf.score.to_numpy()
        last = np.flatnonzero(np.r_[score[1:] != score[:-1], True])
        out, a = [], 0
        for m in drawn(pdf):
            z = a + len(m)
            n, p = np.cumsum(m, 1)[:, last], np.cumsum(m * y, 1)[:, last]
            gained = np.diff(p, axis=1, prepend=0)
            bn, bp, tn, tp = (np.asarray(b[c])[a:z, None] for c in ("bn", "bp", "tn", "tp"))
            with np.errstate(divide="ignore", invalid="ignore"):
                area = np.where(gained > 0, gained / tp * (bp + p) / (bn + n), 0.0).sum(1)
            out.append(np.where((tp > 0) & (tp < tn), area[:, None], np.nan)[:, 0])
            a = z
        return pdf[keys].head(1).assign(ap=[np.concatenate(out)])

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        ap = np.sum(pdf.ap.to_list(), axis=0)
        ap = ap[~np.isnan(ap)]
        low, high = np.percentile(ap, [2.5, 97.5]) if len(ap) else (None, None)
        return pdf[keys].head(1).assign(pr_auc_lo=low, pr_auc_hi=high)

    sums = rows.groupBy(*by).applyInPandas(totals, f"{named}, _r int, n array<long>, p array<long>")
    before = sums.groupBy(*keys).applyInPandas(above, f"{named}, _r int, bn array<long>, bp array<long>, tn array<long>, tp array<long>")
    parts = rows.groupBy(*by).cogroup(before.groupBy(*by)).applyInPandas(areas, f"{named}, ap array<double>")
    out = parts.groupBy(*keys).applyInPandas(bounds, f"{named}, pr_auc_lo double, pr_auc_hi double")
    classes = rows.groupBy(*keys).agg((F.min("y") < F.max("y")).alias("_both"))
    told = lambda c: F.when(F.col("_both"), F.col(c)).alias(c)
    return classes.join(out, keys, "left").select(*keys, told("pr_auc_lo"), told("pr_auc_hi"))


def beside(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The columns of tables that have a row a key at most, beside each other; null where a table lacks the key."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(*keys).agg(*(F.max(c).alias(c) for c in every.columns if c not in keys))


def metrics(predictions: DataFrame, onsets: DataFrame, test_days: DataFrame, run: list[str], horizon: str = "horizon", fold: str = "fold", reps: int = 300, block: int = 60) -> DataFrame:
    """A row a run and horizon, its folds pooled: from alarms to base rate, PR-AUC with its interval, ROC-AUC, confusion, events, false alarms.

    predictions: run, horizon, fold, day, row, y, score, alarm (of test rows); onsets: run, horizon, fold, row and columns
    that tell them apart (of test days); test_days: run, fold, day. `run`: the columns that name a run.
    """
    keys = [*run, horizon]
    predictions = kept(predictions)  # six plans read it
    # Each part has few rows and is written on its own, and the parts are put beside each other without a join: a driver
    # that plans, compiles and watches all of this as one job needs several times the memory.
    numbered, n_rows = row_numbers(predictions.select(*keys, "row", "y", "score"), keys, "row")
    parts = [
        confusion(predictions, keys),
        areas(predictions, keys),
        block_bootstrap(kept(numbered), keys, n_rows, reps=reps, block=block),
        event_summary(event_detection(onsets, predictions, [*keys, fold], horizon), keys),
        false_alarm_episodes(predictions, [*keys, fold, "day"]).groupBy(*keys).agg(F.count("*").alias("_starts")),
    ]
    days = kept(test_days.groupBy(*run).agg(F.count("*").alias("test_days")))
    out = beside([kept(part) for part in parts], keys).where("tp is not null").join(days, run)
    # Each fold's rate weighted by its days: all starts over all days.
    return out.withColumns(
        {
            "pr_lift": F.col("pr_auc") / F.col("base_rate"),
            "n_events": F.coalesce("n_events", F.lit(0)),
            "events_detected": F.coalesce("events_detected", F.lit(0)),
            "false_alarms_per_day": F.coalesce("_starts", F.lit(0)) / F.col("test_days"),
        }
    ).withColumnRenamed("median_lead", "median_lead_min").drop("_starts")


def weighted_mean(value: str, weight: str):
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
