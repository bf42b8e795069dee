"""The study's models over the driver's telemetry: from prepared folds through both models to metrics and the report's model tables.

A model is a system, inputs (level or change), a fold (chrono, cv1, ...) and a horizon. All tables carry these keys; nothing
is looped over. Tables that several queries read (blocks, models, scores) are made once a session and folder of tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.operators import evaluate, logistic, lstm, tensors
from minutewise.operators.stage import kept
from minutewise.operators.tensors import MODEL
from minutewise.plans import report
from minutewise.plans import telemetry as T
from minutewise.plans.catalog import QUERIES, query, r6
from minutewise.plans.report_queries import BASE, HORIZONS, ORDER, RUN, RUNS, SYSTEM, drift, faults, folds, missingness, onsets_tested_of, profiles, run_days_of, system_of, usable
from minutewise.sources.files import write_result

TOP, SEED = 6, 20260916
#: The study's settings in buckets: look-backs (those beyond a day's start are padded), hidden sizes, seeds.
LOOKBACKS, HIDDEN, SEEDS = [1, 2, 3, 6, 12, 24], [8, 16, 32, 64, 128], [SEED + i for i in range(5)]
STUDY = ["system", "lookback", "hidden", "seed"]

_made: dict[tuple[str, str, str], DataFrame] = {}


def once(f: Callable) -> Callable:
    """The table is made once for a session and folder, and kept in the folder for checkpoints."""

    def table(spark, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, f.__name__)
        if key not in _made:
            _made[key] = kept(f(spark, sf))
        return _made[key]

    return table


@once
def recorded(spark, sf) -> DataFrame:
    """day. What follows reads these few rows, not all events once more in each of its plans."""
    return T.days(spark, sf)


@once
def dealt(spark, sf) -> DataFrame:
    """kind, fold, split, day."""
    return folds(spark, sf, recorded(spark, sf))


@once
def arrays(spark, sf) -> DataFrame:
    means = T.means(spark, sf).withColumn("system", system_of())
    return tensors.day_arrays(means, means.select("system").distinct().crossJoin(recorded(spark, sf)), T.BUCKETS, ["system"])


@once
def labelled(spark, sf) -> DataFrame:
    return usable(spark, sf, recorded(spark, sf))


def every_fold(spark, sf) -> DataFrame:
    return dealt(spark, sf).drop("kind")


@once
def fit(spark, sf) -> DataFrame:
    plan = tensors.day_plan(every_fold(spark, sf), labelled(spark, sf), HORIZONS, T.BUCKETS)
    return tensors.fold_fit(arrays(spark, sf), plan, HORIZONS)


@once
def blocks(spark, sf) -> DataFrame:
    # Both are written first: a third of the plan each.
    top = kept(tensors.top_series(fit(spark, sf), HORIZONS, TOP))
    sampled = kept(tensors.samples(labelled(spark, sf), every_fold(spark, sf), SEED))
    return tensors.fold_data(arrays(spark, sf), top, sampled)


FOLDED = f"""{BASE},
gt AS (SELECT component, kpi, day, t - lag(t) OVER (PARTITION BY component, kpi, day ORDER BY t) AS gap FROM gr WHERE value IS NOT NULL),
lt AS (SELECT fold, component, kpi, CAST(greatest(2, 2 * floor(median(gap))) AS INTEGER) AS lim FROM gt JOIN fo USING (day) WHERE split = 'train' AND gap IS NOT NULL GROUP BY ALL),
kt AS (SELECT fold, component, kpi, count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) = count(DISTINCT day) AS every_day, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM gr JOIN fo USING (day) WHERE split = 'train' GROUP BY ALL),
ht AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS v, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS seen_at FROM gr WINDOW w AS (PARTITION BY component, kpi, day ORDER BY t ROWS UNBOUNDED PRECEDING)),
it AS (SELECT fold, split, h.day, h.t, component, kpi, coalesce(lim, 2) AS lim, CASE WHEN h.t - seen_at <= coalesce(lim, 2) THEN v END AS filled FROM ht h JOIN fo ON fo.day = h.day LEFT JOIN lt USING (fold, component, kpi)),
jt AS (SELECT fold, component, kpi, any_value(lim) AS lim, coalesce(median(filled) FILTER (split = 'train'), 0) AS fill, avg(CASE WHEN filled IS NULL THEN 1.0 ELSE 0.0 END) FILTER (split = 'train') AS left_train, avg(CASE WHEN filled IS NULL THEN 1.0 ELSE 0.0 END) AS left_all FROM it GROUP BY ALL),
ct2 AS (SELECT it.*, {SYSTEM} AS system, coalesce(filled, fill) AS clean FROM it JOIN jt USING (fold, component, kpi)),
mt2 AS (SELECT fold, component, kpi, quantile_cont(clean, 0.5) AS med, quantile_cont(clean, 0.25) AS q1, quantile_cont(clean, 0.75) AS q3 FROM ct2 WHERE split = 'train' GROUP BY ALL),
fit AS (SELECT {SYSTEM} AS system, *, every_day AND missing <= 0.8 AS kept, CASE WHEN q3 - q1 > 1e-9 THEN q3 - q1 ELSE 1 END AS iqr FROM kt JOIN jt USING (fold, component, kpi) JOIN mt2 USING (fold, component, kpi)),
ut AS (SELECT c.fold, c.system, c.component, c.kpi, c.day, lu.horizon, lu.y, c.clean, c.clean - avg(c.clean) OVER (PARTITION BY c.fold, c.component, c.kpi, lu.horizon, c.day) AS within FROM ct2 c JOIN lu ON lu.system = c.system AND lu.day = c.day AND lu.t = c.t WHERE c.split = 'train'),
at2 AS (SELECT fold, system, component, kpi, horizon, inputs, y, x - avg(x) OVER (PARTITION BY fold, component, kpi, horizon, inputs) AS x FROM (SELECT *, 'level' AS inputs, clean AS x FROM ut UNION ALL SELECT *, 'change', within FROM ut)),
bt2 AS (SELECT fold, system, component, kpi, horizon, inputs, y, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM at2 GROUP BY ALL),
ff AS (SELECT fold, system, component, kpi, horizon, inputs, CASE WHEN count(*) = 2 AND sum(n) > 2 AND sum(ss) - sum(s * s / n) > 1e-14 * sum(ss) THEN sum(s * s / n) / ((sum(ss) - sum(s * s / n)) / (sum(n) - 2)) ELSE 0 END AS f FROM bt2 GROUP BY ALL),
tp AS (SELECT ff.*, row_number() OVER (PARTITION BY ff.system, inputs, fold, horizon ORDER BY f DESC, component, kpi) AS rank FROM ff JOIN fit USING (fold, system, component, kpi) WHERE kept QUALIFY rank <= {TOP}),
hs AS (SELECT lu.*, fold, split, CAST('0x' || substr(md5(lu.day || '/' || lu.t || '/{SEED}'), 1, 12) AS BIGINT) AS h FROM lu JOIN fo ON fo.day = lu.day),
qs AS (SELECT system, fold, horizon, greatest(5 * count(*) FILTER (y = 1), 500) AS quota FROM hs WHERE split = 'train' GROUP BY ALL),
rs2 AS (SELECT *, row_number() OVER (PARTITION BY system, fold, horizon ORDER BY h % 4096, h, day, t) AS k FROM hs WHERE split = 'train' AND y = 0),
sm AS (SELECT system, fold, horizon, split, day, t, y FROM hs WHERE split <> 'train' OR y = 1 UNION ALL SELECT system, fold, horizon, split, day, t, y FROM rs2 JOIN qs USING (system, fold, horizon) WHERE k <= quota),
zt AS (SELECT c.fold, c.system, c.component, c.kpi, c.day, c.t, greatest(least((clean - med) / iqr, 10), -10) AS z FROM ct2 c JOIN fit USING (fold, system, component, kpi)),
wt AS (SELECT tp.inputs, sm.system, sm.fold, sm.horizon, sm.split, sm.day, sm.t, sm.y, zt.t - sm.t AS step, tp.component || '||' || tp.kpi AS series, z
  FROM sm JOIN tp ON tp.system = sm.system AND tp.fold = sm.fold AND tp.horizon = sm.horizon JOIN zt ON zt.fold = sm.fold AND zt.day = sm.day AND zt.component = tp.component AND zt.kpi = tp.kpi AND zt.t BETWEEN sm.t - 5 AND sm.t)"""


@query(
    f""", {FOLDED} SELECT system, component, kpi, fold, round(missing, 6) AS missing, kept, lim AS fill_limit, round(fill, 6) AS fill, round(med, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
 round(max(f) FILTER (inputs = 'level' AND horizon = 3), 6) AS f_level, round(max(f) FILTER (inputs = 'change' AND horizon = 3), 6) AS f_change FROM fit JOIN ff USING (fold, system, component, kpi) GROUP BY ALL"""
)
def fold_scaling(spark, sf):
    """Each fold's cleaning, exact quartiles and F of each series, from one pass over the days' arrays."""
    f = fit(spark, sf)
    at = HORIZONS.index(3)
    told = f.withColumns({c: r6(c) for c in ("missing", "fill", "median", "q1", "q3", "iqr")}).withColumns({c: r6(F.get(c, F.lit(at))) for c in ("f_level", "f_change")})
    return told.drop("every_day", "left_train", "left_all")


@query(
    f""", {FOLDED} SELECT system, fold, count(*) AS series_raw, count(*) FILTER (NOT every_day) AS dropped_not_every_train_day, count(*) FILTER (every_day AND NOT kept) AS dropped_over_80pct_missing, count(*) FILTER (kept) AS series_kept,
 round(avg(left_train) FILTER (kept), 9) AS missing_after_ffill_train, round(avg(left_all) FILTER (kept), 9) AS missing_after_ffill_all FROM fit GROUP BY ALL"""
)
def fold_prep(spark, sf):
    return tensors.fold_prep(fit(spark, sf)).withColumns({c: F.round(c, 9) for c in ("missing_after_ffill_train", "missing_after_ffill_all")})


@query(f", {FOLDED} SELECT system, inputs, horizon, fold, CAST(rank AS INTEGER) AS rank, component, kpi, round(f, 6) AS f FROM tp")
def fold_series(spark, sf):
    return tensors.top_series(fit(spark, sf), HORIZONS, TOP).select("system", "inputs", "horizon", "fold", "rank", "component", "kpi", r6("f").alias("f"))


@query(
    f""", {FOLDED} SELECT system, inputs, fold, horizon, split, day, t, y, CAST(step AS INTEGER) AS step, series, round(CASE WHEN inputs = 'level' THEN z ELSE greatest(least(z - quantile_cont(z, 0.5) OVER (PARTITION BY system, inputs, fold, horizon, day, t, series), 10), -10) END, 6) AS value
 FROM wt WHERE fold = 'chrono' AND horizon = 3"""
)
def fold_windows(spark, sf):
    """The chronological fold's windows of horizon 3, spelled out; change inputs less their median."""
    b = blocks(spark, sf).where("fold = 'chrono' and horizon = 3")
    rows = tensors.window_rows(b, T.LOOKBACK)
    own = rows.groupBy(*MODEL, "split", "day", "t", "series").agg(F.percentile("value", 0.5).alias("_m"))
    change = F.greatest(F.least(F.col("value") - F.col("_m"), F.lit(10.0)), F.lit(-10.0))
    return rows.join(own, [*MODEL, "split", "day", "t", "series"]).withColumn("value", r6(F.when(F.col("inputs") == "level", F.col("value")).otherwise(change))).drop("_m")


SPLITS = f"""{FOLDED},
sx AS (SELECT system, CASE WHEN fold = 'chrono' THEN 'chrono' ELSE 'cv' END || '-' || inputs AS run, fold, split, horizon, string_agg(DISTINCT CAST(day AS VARCHAR), ', ' ORDER BY CAST(day AS VARCHAR)) AS days,
  count(DISTINCT (day, t)) AS windows, count(DISTINCT CASE WHEN y = 1 THEN (day, t) END) AS positive, count(DISTINCT (day, t)) || ' x 6 x ' || count(DISTINCT series) AS shape, avg(CASE WHEN abs(z) >= 10 THEN 1.0 ELSE 0.0 END) AS clipped_share FROM wt GROUP BY ALL)"""


def run_name(suffix: str = "") -> F.Column:
    """chrono-level, cv-change, ..."""
    return F.concat(F.when(F.col("fold") == "chrono", "chrono").otherwise("cv"), F.lit("-"), F.col("inputs"), F.lit(suffix))


def splits(spark, sf) -> DataFrame:
    return tensors.split_table(blocks(spark, sf), T.LOOKBACK).withColumn("run", run_name()).drop("inputs")


@query(f", {SPLITS} SELECT system, run, fold, split, horizon, days, windows, positive, shape, round(clipped_share, 6) AS clipped_share FROM sx")
def run_splits(spark, sf):
    return splits(spark, sf).withColumn("clipped_share", r6("clipped_share"))


@query(
    f""", {SPLITS} SELECT system, upper(left(split, 1)) || substr(split, 2) AS split, regexp_replace(days, '20\\d\\d-', '', 'g') AS days, windows, positive, printf('%.1f%%', round(100.0 * positive / windows, 1)) AS share, shape FROM sx WHERE run = 'chrono-level' AND horizon = 3"""
)
def q14_split_table(spark, sf):
    return report.split_table(splits(spark, sf).where("run = 'chrono-level'"), 3, r"20\d\d-")


# Models


@once
def logistic_scores(spark, sf) -> DataFrame:
    level = blocks(spark, sf).where("inputs = 'level'")
    scores, told = logistic.logistic_scores(level, T.LOOKBACK)
    _made[spark.sparkContext.applicationId, sf, "logistic_models"] = kept(told)
    return scores


def logistic_models(spark, sf) -> DataFrame:
    logistic_scores(spark, sf)
    return _made[spark.sparkContext.applicationId, sf, "logistic_models"]


@query()
def logreg_scores(spark, sf):
    return logistic_scores(spark, sf).where("split = 'test'").select(*MODEL, "day", "t", "y", "score")


@query()
def logreg_history(spark, sf):
    """The chosen C of each model, its validation PR-AUC and its number of inputs."""
    return logistic_models(spark, sf).select("system", "fold", "horizon", "c", "val_pr_auc", "n_inputs")


@once
def models(spark, sf) -> DataFrame:
    return lstm.fit_models(blocks(spark, sf), MODEL, lookback=T.LOOKBACK, seed=SEED)


@once
def recurrent_scores(spark, sf) -> DataFrame:
    return lstm.lstm_scores(blocks(spark, sf), models(spark, sf), MODEL, T.LOOKBACK)


DEFAULT = "inputs = 'level' and fold = 'chrono' and horizon = 3"


@query()
def lstm_history(spark, sf):
    return lstm.history(models(spark, sf), MODEL)


@query()
def lstm_scores(spark, sf):
    return recurrent_scores(spark, sf)


@query()
def lstm_gates(spark, sf):
    return lstm.lstm_gates(blocks(spark, sf).where("inputs = 'level'"), models(spark, sf).where("inputs = 'level'"), MODEL, T.LOOKBACK)


@once
def saliency(spark, sf) -> DataFrame:
    return lstm.lstm_saliency(blocks(spark, sf).where("inputs = 'level'"), models(spark, sf).where("inputs = 'level'"), MODEL, T.LOOKBACK)


@query()
def lstm_saliency(spark, sf):
    return lstm.saliency_time(saliency(spark, sf), MODEL)


@query()
def lstm_top_features(spark, sf):
    return lstm.saliency_feature(saliency(spark, sf), MODEL)


@once
def study(spark, sf) -> DataFrame:
    """A row a setting: the sweeps over look-backs, hidden sizes and seeds of the default model (chronological, level, horizon 3)."""
    settings = {(n, 64, SEED) for n in LOOKBACKS} | {(T.LOOKBACK, d, SEED) for d in HIDDEN} | {(T.LOOKBACK, 64, s) for s in SEEDS}
    asked = spark.createDataFrame(sorted(settings), "lookback int, hidden int, seed long")
    # The default's blocks once a setting: days x series, however long the look-back.
    rows = blocks(spark, sf).where(DEFAULT).crossJoin(F.broadcast(asked))
    fitted = kept(lstm.fit_models(rows, STUDY))
    scores = kept(lstm.lstm_scores(rows, fitted, STUDY).withColumn("row", T.row_of("day", "t")))
    return lstm.sweep(scores, fitted, STUDY, ["row"])


@query()
def lstm_study(spark, sf):
    return study(spark, sf)


def swept(spark, sf, column: str) -> DataFrame:
    """The settings of one sweep: the others at their defaults."""
    defaults = {"lookback": T.LOOKBACK, "hidden": 64, "seed": SEED}
    out = study(spark, sf)
    for c, v in defaults.items():
        out = out if c == column else out.where(F.col(c) == v)
    return out.where(F.col("lookback").isin(LOOKBACKS) & F.col("hidden").isin(HIDDEN))


# From scores to metrics


@once
def predictions(spark, sf) -> DataFrame:
    """system, run, fold, horizon, day, t, row, y, score, threshold, alarm of the test samples of both models.

    A fold's threshold is its validation scores' quantile, in the scores' own type: float those of the recurrent model, double the others."""
    one = lambda scores, suffix: scores.select("system", run_name(suffix).alias("run"), "fold", "horizon", "split", "day", "t", "y", F.col("score").cast("double").alias("score"))
    rows = kept(one(recurrent_scores(spark, sf), "").unionByName(one(logistic_scores(spark, sf), "-logreg")))
    keys = [*RUN, "fold", "horizon"]
    cut = evaluate.thresholds(rows.where("split = 'val'"), keys, 0.1)
    own = F.when(F.col("run").endswith("-logreg"), F.col("threshold")).otherwise(F.col("threshold").cast("float").cast("double"))
    out = rows.where("split = 'test'").join(cut, keys).withColumn("threshold", own)
    return out.select(*keys, "day", "t", T.row_of("day", "t").alias("row"), "y", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("alarm"))


def test_days(spark, sf) -> DataFrame:
    """run, fold, day of the test days of every run."""
    return run_days_of(dealt(spark, sf), ["level", "change", "level-logreg"])


def onsets(spark, sf) -> DataFrame:
    """The onsets on the test days of every run."""
    return onsets_tested_of(spark, sf, test_days(spark, sf), recorded(spark, sf))


@once
def metrics(spark, sf) -> DataFrame:
    """Metrics of each run and horizon, folds pooled, with the mean number of epochs."""
    systems = spark.createDataFrame([("Bank",), ("Telecom",)], "system string")
    out = evaluate.metrics(predictions(spark, sf), onsets(spark, sf), test_days(spark, sf).crossJoin(systems), RUN)
    epochs = models(spark, sf).withColumn("run", run_name()).groupBy(*RUN, "horizon").agg(F.avg(F.size("epoch")).alias("epochs_run"))
    return out.join(epochs, [*RUN, "horizon"], "left").withColumn("epochs_run", F.when(F.col("run").endswith("-logreg"), 1.0).otherwise(F.col("epochs_run")))


@query()
def model_predictions(spark, sf):
    return predictions(spark, sf)


@query()
def model_metrics(spark, sf):
    return metrics(spark, sf)


@query()
def model_metrics_table(spark, sf):
    return report.metrics_table(metrics(spark, sf), keys=tuple(RUN))


@query()
def model_events(spark, sf):
    found = evaluate.event_detection(onsets(spark, sf), predictions(spark, sf), [*RUN, "fold", "horizon"], "horizon")
    return found.withColumnRenamed("lead", "lead_min")


@query()
def model_timeline(spark, sf):
    p = predictions(spark, sf).where("system = 'Bank' and run = 'chrono-level'").withColumn("timestamp", T.row_of("day", "t") * 1800)
    scores, _ = report.timeline(p.drop("threshold", "day"), p.select("horizon", "threshold").distinct(), faults(spark, sf), "Bank", "2024-01-15", horizon=3, offset=0)
    return scores.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "day", "y", "score", "threshold", "alarm")


@query()
def model_lift_by_run(spark, sf):
    shown = metrics(spark, sf).where(F.expr(RUNS).isNotNull()).withColumns({"run_order": F.expr(ORDER), "run": F.expr(RUNS)})
    return report.lift_by_run(shown, ("system",))


@query()
def model_compare_systems(spark, sf):
    return report.compare_systems(metrics(spark, sf).where("run = 'chrono-level'"))


# The report's tables of the recurrent model


@query()
def q10_history(spark, sf):
    table = lstm.history(models(spark, sf).where("inputs = 'level' and fold = 'chrono'"), MODEL).drop("inputs")
    return report.history_long(table, ("system",))


@query()
def q15_study_lifts(spark, sf):
    return report.study_lifts(swept(spark, sf, "lookback"), swept(spark, sf, "hidden"))


@query()
def q16_seed_stability(spark, sf):
    return report.seed_stability(swept(spark, sf, "seed"))


@query()
def q17_gates(spark, sf):
    b, m = blocks(spark, sf).where(DEFAULT), models(spark, sf).where(DEFAULT)
    return report.gates_by_minute(lstm.lstm_gates(b, m, MODEL, T.LOOKBACK).drop("inputs", "fold", "horizon"))


@query()
def q18_saliency_by_minute(spark, sf):
    return report.saliency_by_minute(lstm.saliency_time(saliency(spark, sf).where(DEFAULT), MODEL))


@query()
def q19_top_features(spark, sf):
    return report.top_features(lstm.saliency_feature(saliency(spark, sf).where(DEFAULT), MODEL), 8)


def write_results(spark, sf, path: str, recurrent: bool = True) -> list[str]:
    """Writes the study's result tables as CSV folders under `path`, and returns their names. recurrent: those of the models too."""
    tables = {
        "split": splits(spark, sf), "prep": fold_prep(spark, sf), "drift": drift(spark, sf), "missingness": missingness(spark, sf), "onset_profile": profiles(spark, sf), "closeup": QUERIES["q6_closeup_panels"](spark, sf),
    }
    if recurrent:
        tables |= {
            "metrics": metrics(spark, sf), "predictions": predictions(spark, sf).select(*RUN, "horizon", "fold", (F.col("row") * 1800).alias("timestamp"), "y", "score", "alarm"), "events": model_events(spark, sf),
            "history": lstm_history(spark, sf), "history_logreg": logreg_history(spark, sf), "lookback": swept(spark, sf, "lookback"), "hidden": swept(spark, sf, "hidden"), "seeds": swept(spark, sf, "seed"),
            "gates": lstm_gates(spark, sf), "saliency_time": lstm_saliency(spark, sf), "saliency_feature": lstm_top_features(spark, sf),
        }
    for name, table in tables.items():
        write_result(table, f"{path}/{name}")
    return list(tables)
