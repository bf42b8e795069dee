"""Balanced logistic regression on window summaries, all models at once: Newton steps from sums over partitions.

A model minimises 0.5 |w|^2 + C * sum of s_i * log loss, with weights s_i = n / (2 * rows of the class) and a free
intercept, for each C of the grid, on six summaries a series (last, mean, population deviation, minimum, maximum, last less
first), standardised by the training rows. Every model (system, inputs, fold, horizon) and every C take the same steps:
each partition adds up loss, gradient and Hessian of the blocks it holds, the partial sums are added by model, and the
solved step is the next table of coefficients. No model's rows meet in one task, and a step is one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.operators.evaluate import pr_auc
from minutewise.operators.stage import kept
from minutewise.operators.tensors import MODEL, block_windows

#: Fixed values.
C_GRID = [0.001, 0.01, 0.1, 1.0]
STEPS, CLOSE = 60, 1e-10
BROADCAST_NUMBERS = 4_000_000


def kinds(rows: DataFrame, columns: list[str]) -> str:
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"{c} {of[c]}" for c in columns)


def window_summaries(w: np.ndarray) -> np.ndarray:
    """n x 6k: the six summaries of each series, series by series."""
    parts = [w[:, -1], w.mean(1), w.std(1), w.min(1), w.max(1), w[:, -1] - w[:, 0]]
    return np.stack(parts, 2).reshape(len(w), -1)


def summaries(blocks: DataFrame, lookback: int) -> DataFrame:
    """MODEL, split, day, ts, ys, x: the samples' summaries of a block in a row."""
    columns = [*MODEL, "split", "day", "ts", "ys"]

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = zip(pdf.x, pdf.ts, pdf.series, pdf.inputs, strict=True)
            yield pdf[columns].assign(x=[window_summaries(block_windows(x, ts, len(s), lookback, i == "change")).ravel() for x, ts, s, i in rows])

    return blocks.mapInPandas(made, kinds(blocks, columns) + ", x array<double>")


def added(frames: Iterator[pd.DataFrame], of, by: list[str], flush: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Sums of the vectors of(row) by model over a partition; they are let go whenever they hold `flush` numbers."""
    sums: dict[tuple, np.ndarray] = {}
    out = lambda: pd.DataFrame([(*key, s) for key, s in sums.items()], columns=[*by, "s"])
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            key = tuple(getattr(row, c) for c in by)
            s = of(row)
            sums[key] = sums[key] + s if key in sums else s
            if len(sums) * len(s) > flush:
                yield out()
                sums.clear()
    if sums:
        yield out()


def summed(rows: DataFrame, of, by: list[str] = MODEL) -> DataFrame:
    """by, s: partial sums of the vectors of(row), a row a model and partition."""
    return rows.mapInPandas(lambda frames: added(frames, of, by), kinds(rows, by) + ", s array<double>")


def matrix(row, p: int) -> np.ndarray:
    return np.reshape(row.x, (-1, p))


def standards(train: DataFrame, grid: list[float]) -> DataFrame:
    """The models' table before the first step: MODEL, p, mean, sd, n, positive, w (0), and what steps need."""

    def first(row) -> np.ndarray:
        x = np.reshape(row.x, (len(row.ts), -1))
        return np.r_[len(x), sum(row.ys), x.sum(0)]

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(pdf.s.to_list(), axis=0)
        return pdf[MODEL].head(1).assign(n=s[0], positive=s[1], mean=[s[2:] / s[0]])

    centred = summed(train, first).groupBy(*MODEL).applyInPandas(means, kinds(train, MODEL) + ", n double, positive double, mean array<double>")
    centred = kept(centred.where("positive > 0 and positive < n"))  # a set of one class has no finite intercept

    def second(row) -> np.ndarray:
        return ((matrix(row, len(row.mean)) - row.mean) ** 2).sum(0)

    def deviations(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[MODEL].head(1).assign(ss=[np.sum(pdf.s.to_list(), axis=0)])

    spread = summed(train.join(centred, MODEL), second).groupBy(*MODEL).applyInPandas(deviations, kinds(train, MODEL) + ", ss array<double>")
    sd = F.transform("ss", lambda v: F.when(F.sqrt(v / F.col("n")) > 1e-9, F.sqrt(v / F.col("n"))).otherwise(1.0))
    p = F.size("mean")
    zero = F.array_repeat(F.lit(0.0), (p + 1) * len(grid))
    return centred.join(spread, MODEL).select(*MODEL, p.alias("p"), "mean", sd.alias("sd"), "n", "positive", zero.alias("w"), zero.alias("before"), F.array_repeat(F.lit(float("inf")), len(grid)).alias("loss"), F.lit(float("inf")).alias("moved"))


def with_one(row) -> np.ndarray:
    """Standardised summaries and a last column of ones."""
    x = (matrix(row, row.p) - row.mean) / row.sd
    return np.c_[x, np.ones(len(x))]


def fits(models: DataFrame, grid: list[float]) -> bool:
    """Whether the models' table was counted to have no more than BROADCAST_NUMBERS numbers, and may be broadcast."""
    return (models.agg(F.sum((2 * len(grid) + 2) * (F.col("p") + 1))).first()[0] or 0) <= BROADCAST_NUMBERS


def fit_logistic(train: DataFrame, grid: list[float] | None = None, steps: int = STEPS) -> DataFrame:
    """MODEL, p, mean, sd, n, positive, w (a row of p + 1 coefficients for each C, the intercept last), loss. train: summaries()."""
    grid = grid or C_GRID
    models = kept(standards(train, grid))

    def sums(row) -> np.ndarray:
        x, y, q = with_one(row), np.asarray(row.ys, float), row.p + 1
        s = np.where(y == 1, row.n / (2 * row.positive), row.n / (2 * (row.n - row.positive)))
        out = []
        for w in np.reshape(row.w, (len(grid), q)):
            z = x @ w
            h = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            out += [[(s * (np.logaddexp(0, z) - y * z)).sum()], x.T @ (s * (h - y)), ((x * (s * h * (1 - h))[:, None]).T @ x).ravel()]
        return np.concatenate(out)

    def step(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(state):
            return state.head(0)
        row = state.iloc[0]
        q, parts = row.p + 1, np.sum(pdf.s.to_list(), axis=0).reshape(len(grid), -1)
        old, before, last = np.reshape(row.w, (len(grid), q)), np.reshape(row.before, (len(grid), q)), row.loss
        new, base, loss, moved = old.copy(), old.copy(), np.array(last, float), 0.0
        free = np.r_[np.ones(q - 1), 0.0]
        for i, c in enumerate(grid):
            now = c * parts[i, 0] + 0.5 * (free * old[i] ** 2).sum()
            if now > last[i] + 1e-9 * abs(last[i]):
                new[i], base[i] = (old[i] + before[i]) / 2, before[i]  # too far: half the way
            else:
                gradient = c * parts[i, 1 : 1 + q] + free * old[i]
                hessian = c * parts[i, 1 + q :].reshape(q, q) + np.diag(free + 1e-12)
                new[i], loss[i] = old[i] - np.linalg.solve(hessian, gradient), now
            moved = max(moved, np.abs(new[i] - old[i]).max())
        return state.head(1).assign(w=[new.ravel()], before=[base.ravel()], loss=[loss], moved=moved)

    schema, few = models.schema, fits(models, grid)  # no step changes a model's size
    for _ in range(steps):
        partial = summed(train.join(F.broadcast(models) if few else models, MODEL), sums)
        models = kept(partial.groupBy(*MODEL).cogroup(models.groupBy(*MODEL)).applyInPandas(step, schema))
        far = models.agg(F.max("moved")).first()[0]
        if far is None or far < CLOSE:
            break
    return models.select(*MODEL, "p", "mean", "sd", "n", "positive", "w", "loss")


def score(models: DataFrame, rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """MODEL, c, split, day, t, y, score of rows (summaries())."""
    grid = grid or C_GRID
    columns = [*MODEL, "split", "day"]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                z = with_one(row) @ np.reshape(row.w, (len(grid), row.p + 1)).T
                n = len(row.ts)
                one = pd.DataFrame({c: [getattr(row, c)] * (n * len(grid)) for c in columns})
                out.append(one.assign(c=np.tile(grid, n), t=np.repeat(row.ts, len(grid)), y=np.repeat(row.ys, len(grid)), score=(1 / (1 + np.exp(-z))).ravel()))
            if out:
                yield pd.concat(out)

    return rows.join(F.broadcast(models) if fits(models, grid) else models, MODEL).mapInPandas(scored, kinds(rows, columns) + ", c double, t int, y int, score double")


def choose_c(scores: DataFrame) -> DataFrame:
    """MODEL, c, val_pr_auc: the first C of the best validation PR-AUC (null counts as 0)."""
    tried = pr_auc(scores.where("split = 'val'"), [*MODEL, "c"]).withColumn("_ap", F.coalesce("pr_auc", F.lit(0.0)))
    best = tried.groupBy(*MODEL).agg(F.max(F.struct("_ap", -F.col("c"))).alias("_b"))
    return best.select(*MODEL, (-F.col("_b")["col2"]).alias("c"), F.col("_b")["_ap"].alias("val_pr_auc"))


def logistic_scores(blocks: DataFrame, lookback: int, grid: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of validation and test samples by each model's chosen C; and the models: MODEL, c, val_pr_auc, n_inputs."""
    parts = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    rows = kept(summaries(blocks, lookback).repartition(parts, *MODEL, "day"))
    models = fit_logistic(rows.where("split = 'train'"), grid)
    scores = kept(score(models, rows.where("split <> 'train'"), grid))
    chosen = kept(choose_c(scores))
    told = chosen.join(models.select(*MODEL, F.col("p").alias("n_inputs")), MODEL)
    return scores.join(chosen.select(*MODEL, "c"), [*MODEL, "c"]).drop("c"), told
