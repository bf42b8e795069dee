"""The report's queries over tables derived from the driver's: two systems, their faults, scores and metrics.

A system is the even or the odd half of the components. Here a bucket's score is its mean reading (`level`) or the distance
of that from the median of the last six (`change`), which SQL can score too; plans/models.py applies the same functions to
the trained models. Each query derives its input and applies the function of report.py.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutewise.functions.scalars import clip
from minutewise.operators import clean, evaluate, explore, features
from minutewise.operators.folds import chrono_folds, cv_folds
from minutewise.operators.grid import exact_grid
from minutewise.operators.labels import label_and_mask
from minutewise.operators.stage import kept
from minutewise.plans import report
from minutewise.plans import telemetry as T
from minutewise.plans.catalog import QUERIES, SERIES, bootstrap_sql, query, r6

HORIZONS = [1, 3, 6]
RUN = ["system", "run"]
KEYS = [*RUN, "horizon"]


def system_of(component: str = "component") -> Column:
    return F.when(F.col(component).isin("c0", "c2"), "Bank").otherwise("Telecom")


SYSTEM = "CASE WHEN component IN ('c0', 'c2') THEN 'Bank' ELSE 'Telecom' END"


def auc_sql(source: str, keys: list[str], to: str) -> str:
    """Common table expressions up to `to` (keys, pr_auc, roc_auc, base) for a source of keys, y, score."""
    k = ", ".join(keys)
    return f"""{to}_t AS (SELECT {k}, score, count(*) AS n, sum(y) AS p FROM {source} GROUP BY ALL),
{to}_c AS (SELECT *, sum(n) OVER d AS cn, sum(p) OVER d AS cp, sum(p) OVER (PARTITION BY {k}) AS tp, sum(n) OVER (PARTITION BY {k}) AS tn, sum(n) OVER u AS un FROM {to}_t
 WINDOW d AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY {k} ORDER BY score ROWS UNBOUNDED PRECEDING)),
{to} AS (SELECT {k}, CASE WHEN max(tp) > 0 THEN sum(CASE WHEN tp > 0 THEN p / tp * cp / cn END) END AS pr_auc, max(tp) / max(tn) AS base,
 CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN (sum((un - (n - 1) / 2) * p) - max(tp) * (max(tp) + 1) / 2) / (max(tp) * (max(tn) - max(tp))) END AS roc_auc FROM {to}_c GROUP BY ALL)"""


BASE = f"""
fb AS (SELECT {SYSTEM} AS system, 'pod' AS level, component, reason, ts AS onset, day, t, event_id FROM fa),
sr AS (SELECT {SYSTEM} AS system, day, t, round(avg(value), 9) AS score FROM rd GROUP BY ALL),
w6 AS (SELECT * FROM (SELECT system, day, t, list(score) OVER (PARTITION BY system, day ORDER BY t ROWS 5 PRECEDING) AS w FROM sr) WHERE len(w) = 6),
rs AS (SELECT system, day, t, 'level' AS inputs, w[6] AS score FROM w6 UNION ALL SELECT system, day, t, 'change', greatest(least(w[6] - list_median(w), 10), -10) FROM w6),
lq AS (SELECT s.system, c.day, c.t, h.horizon,
  CAST(EXISTS (SELECT 1 FROM fb WHERE fb.system = s.system AND fb.day = c.day AND fb.t > c.t AND fb.t <= c.t + h.horizon) AS INTEGER) AS y,
  EXISTS (SELECT 1 FROM fb WHERE fb.system = s.system AND fb.day = c.day AND fb.t BETWEEN c.t - 2 AND c.t) AS dark
  FROM (SELECT unnest(['Bank', 'Telecom']) AS system) s CROSS JOIN (SELECT day, t FROM dy CROSS JOIN bk) c CROSS JOIN hz h),
lu AS (SELECT system, day, t, horizon, y FROM lq WHERE t >= 5 AND t + horizon <= 47 AND (y = 1 OR NOT dark)),
fo AS (SELECT 'chrono' AS kind, * FROM ch UNION ALL SELECT 'cv' AS kind, * FROM cf),
sd AS (SELECT lu.system, kind || '-' || inputs AS run, fold, horizon, split, lu.day, lu.t, CAST(datediff('day', DATE '1970-01-01', lu.day) AS BIGINT) * 48 + lu.t AS row, y, score
  FROM lu JOIN fo ON fo.day = lu.day JOIN rs ON rs.system = lu.system AND rs.day = lu.day AND rs.t = lu.t)"""
PREDICTED = f"""{BASE},
th AS (SELECT system, run, fold, horizon, quantile_cont(score, 0.9) AS threshold FROM sd WHERE split = 'val' GROUP BY ALL),
pd AS (SELECT sd.*, threshold, score >= threshold AS alarm FROM sd JOIN th USING (system, run, fold, horizon) WHERE split = 'test')"""
METRICS = f"""{PREDICTED},
pn AS (SELECT system, run, horizon, y, score, row_number() OVER (PARTITION BY system, run, horizon ORDER BY row) - 1 AS i FROM pd),
{auc_sql("pd", KEYS, "au")}, {bootstrap_sql("pn", KEYS, "bt")},
cm AS (SELECT system, run, horizon, count(*) FILTER (alarm AND y = 1) AS tp, count(*) FILTER (alarm AND y = 0) AS fp, count(*) FILTER (NOT alarm AND y = 1) AS fn, count(*) FILTER (NOT alarm AND y = 0) AS tn FROM pd GROUP BY ALL),
td2 AS (SELECT kind || '-' || inputs AS run, fold, day FROM fo CROSS JOIN (SELECT unnest(['level', 'change']) AS inputs) WHERE split = 'test'),
eo AS (SELECT fb.system, run, fold, horizon, event_id, CAST(datediff('day', DATE '1970-01-01', fb.day) AS BIGINT) * 48 + fb.t AS row FROM fb JOIN td2 ON td2.day = fb.day CROSS JOIN hz),
ed AS (SELECT eo.*, max(eo.row - pd.row) AS lead FROM eo LEFT JOIN pd ON pd.alarm AND pd.system = eo.system AND pd.run = eo.run AND pd.fold = eo.fold AND pd.horizon = eo.horizon AND pd.row BETWEEN eo.row - eo.horizon AND eo.row - 1 GROUP BY ALL),
es AS (SELECT system, run, horizon, count(*) AS n_events, count(lead) AS events_detected, count(lead) / count(*) AS event_recall, median(lead) AS median_lead_min FROM ed GROUP BY ALL),
fs AS (SELECT *, alarm AND y = 0 AS now, lag(alarm AND y = 0) OVER w AS before, lag(row) OVER w AS row_before FROM pd WINDOW w AS (PARTITION BY system, run, fold, horizon ORDER BY row)),
fc AS (SELECT system, run, horizon, count(*) AS starts FROM fs WHERE now AND NOT coalesce(before AND row - row_before = 1, false) GROUP BY ALL),
mt AS (SELECT cm.*, au.base AS base_rate, au.pr_auc, au.roc_auc, pr_auc_lo, pr_auc_hi, au.pr_auc / au.base AS pr_lift, coalesce(n_events, 0) AS n_events, coalesce(events_detected, 0) AS events_detected,
  event_recall, median_lead_min, test_days, coalesce(starts, 0) / test_days AS false_alarms_per_day
  FROM cm JOIN au USING (system, run, horizon) JOIN bt USING (system, run, horizon) LEFT JOIN es USING (system, run, horizon) LEFT JOIN fc USING (system, run, horizon)
  JOIN (SELECT run, count(*) AS test_days FROM td2 GROUP BY run) USING (run))"""


def faults(spark, sf) -> DataFrame:
    return T.faults(spark, sf).select(system_of().alias("system"), F.lit("pod").alias("level"), "component", "reason", F.col("ts").alias("timestamp"), F.col("ts").alias("onset"), "day", "t", "event_id")


def windows(spark, sf) -> DataFrame:
    """system, day, t, window: the scores of the last six buckets."""
    score = T.readings(spark, sf).groupBy(system_of().alias("system"), "day", "t").agg(F.round(F.avg("value"), 9).alias("score"))
    return features.look_back(score, T.LOOKBACK, ["system", "day"], "score").drop("score")


def folds(spark, sf, days: DataFrame | None = None) -> DataFrame:
    """kind, fold, split, day. days: the recorded days, if they are at hand (as below)."""
    days = T.days(spark, sf) if days is None else days
    return chrono_folds(days).withColumn("kind", F.lit("chrono")).unionByName(cv_folds(days).withColumn("kind", F.lit("cv")))


def usable(spark, sf, days: DataFrame | None = None) -> DataFrame:
    """system, day, t, horizon, y of usable buckets."""
    systems = spark.createDataFrame([("Bank",), ("Telecom",)], "system string")
    cells = systems.crossJoin(T.days(spark, sf) if days is None else days).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(T.BUCKETS - 1))))
    return label_and_mask(cells, faults(spark, sf), HORIZONS, T.BUCKETS, T.LOOKBACK - 1, T.BLACKOUT, ("system", "day")).where("usable").select("system", "day", "t", "horizon", "y")


def scored(spark, sf) -> DataFrame:
    """system, run, fold, horizon, split, day, t, row, y, score, window."""
    w = windows(spark, sf)
    level = w.withColumns({"inputs": F.lit("level"), "score": F.element_at("window", -1)})
    change = features.change_inputs(w.withColumn("_w", F.col("window"))).select("system", "day", "t", F.col("_w").alias("window"), F.lit("change").alias("inputs"), F.element_at("window", -1).alias("score"))
    rows = usable(spark, sf).join(folds(spark, sf), "day").join(level.unionByName(change), ["system", "day", "t"])
    return rows.select("system", F.concat_ws("-", "kind", "inputs").alias("run"), "fold", "horizon", "split", "day", "t", T.row_of("day", "t").alias("row"), "y", "score", "window")


def predicted(spark, sf) -> DataFrame:
    """Test rows with the threshold of their fold's validation rows and the alarm."""
    rows = scored(spark, sf).drop("window")
    cut = evaluate.thresholds(rows.where("split = 'val'"), [*RUN, "fold", "horizon"], 0.1)
    return rows.where("split = 'test'").join(cut, [*RUN, "fold", "horizon"]).withColumn("alarm", F.col("score") >= F.col("threshold"))


def run_days_of(dealt: DataFrame, inputs: list[str]) -> DataFrame:
    """run, fold, day of the test days of the folds `dealt`, of runs with these inputs."""
    runs = dealt.where("split = 'test'").withColumn("inputs", F.explode(F.array(*map(F.lit, inputs))))
    return runs.select(F.concat_ws("-", "kind", "inputs").alias("run"), "fold", "day")


def run_days(spark, sf) -> DataFrame:
    return run_days_of(folds(spark, sf), ["level", "change"])


def onsets_tested_of(spark, sf, tested: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """system, run, fold, horizon, event_id, component, reason, row of the onsets on the test days (run, fold, day)."""
    grid = exact_grid(T.days(spark, sf) if days is None else days, T.BUCKETS).withColumn("row", T.row_of("day", "t"))
    onsets = evaluate.located(faults(spark, sf), grid, ["day", "t"]).join(tested, "day").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    return onsets.select(*RUN, "fold", "horizon", "event_id", "component", "reason", "row")


def onsets_tested(spark, sf) -> DataFrame:
    return onsets_tested_of(spark, sf, run_days(spark, sf))


def metrics(spark, sf) -> DataFrame:
    tested = run_days(spark, sf).crossJoin(spark.createDataFrame([("Bank",), ("Telecom",)], "system string"))
    return evaluate.metrics(predicted(spark, sf), onsets_tested(spark, sf), tested, RUN)


def events(spark, sf) -> DataFrame:
    """Each onset of each run with whether it was detected, and how long before."""
    return evaluate.event_detection(onsets_tested(spark, sf), predicted(spark, sf), [*RUN, "fold", "horizon"], "horizon").withColumnRenamed("lead", "lead_min")


@query(f", {BASE} SELECT system, level, component, reason, strftime(onset, '%Y-%m-%d %H:%M:%S') AS onset FROM fb QUALIFY row_number() OVER (PARTITION BY system ORDER BY onset, component, reason) <= 3")
def q1_first_faults(spark, sf):
    return report.first_faults(faults(spark, sf)).withColumn("onset", F.date_format("onset", "yyyy-MM-dd HH:mm:ss"))


@query(f", {BASE} SELECT system, reason, faults, printf('%.0f%%', round(100.0 * faults / sum(faults) OVER (PARTITION BY system))) AS share FROM (SELECT system, reason, count(*) AS faults FROM fb GROUP BY ALL)")
def q2_fault_types(spark, sf):
    return report.fault_types(faults(spark, sf))


@query(f", {BASE} SELECT system, count(*) AS days_with_faults, min(n) AS min_per_day, max(n) AS max_per_day, CAST(sum(n) AS BIGINT) AS total FROM (SELECT system, day, count(*) AS n FROM fb GROUP BY ALL) GROUP BY system")
def q3_faults_per_day(spark, sf):
    return report.faults_per_day(faults(spark, sf))


@query(f", {BASE} SELECT s.system, dy.day, count(fb.event_id) AS faults, strftime(dy.day, '%m-%d') AS label FROM (SELECT unnest(['Bank', 'Telecom']) AS system) s CROSS JOIN dy LEFT JOIN fb ON fb.system = s.system AND fb.day = dy.day GROUP BY ALL")
def q4_faults_on_recorded_days(spark, sf):
    # The recorded days come from a split table, in which they are joined to one text.
    split = T.chrono(spark, sf).groupBy("split").agg(F.array_join(F.array_sort(F.collect_list(F.col("day").cast("string"))), ", ").alias("days"))
    days = report.recorded_days(split)
    return report.faults_on_recorded_days(faults(spark, sf), report.both(days, days))


GAPS = "gp AS (SELECT component, kpi, t - lag(t) OVER (PARTITION BY component, kpi, day ORDER BY t) AS gap FROM gr JOIN td USING (day) WHERE value IS NOT NULL), lm AS (SELECT component, kpi, CAST(greatest(2, 2 * floor(coalesce(median(gap), 1.0))) AS INTEGER) AS lim FROM gp GROUP BY ALL)"
MISSING = f"""{GAPS}, hd AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY component, kpi, day ORDER BY t ROWS UNBOUNDED PRECEDING) AS seen_at FROM gr),
kp AS (SELECT component, kpi FROM gr JOIN td USING (day) GROUP BY ALL HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) = (SELECT count(*) FROM td) AND avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.8),
ms AS (SELECT component, kpi, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS raw, CASE WHEN bool_or(kept) THEN avg(CASE WHEN coalesce(t - seen_at <= lim, false) THEN 0.0 ELSE 1.0 END) END AS after_cleaning
 FROM hd LEFT JOIN lm USING (component, kpi) LEFT JOIN (SELECT *, true AS kept FROM kp) USING (component, kpi) GROUP BY ALL)"""


def missingness(spark, sf):
    return clean.missingness(kept(T.grid(spark, sf)), T.train_days(spark, sf))


@query(f", {MISSING} SELECT component, kpi, round(raw, 6) AS raw, round(after_cleaning, 6) AS after_cleaning FROM ms")
def series_missingness(spark, sf):
    return missingness(spark, sf).select(*SERIES, r6("raw").alias("raw"), r6("after_cleaning").alias("after_cleaning"))


@query(
    f""", {MISSING}, lo AS (SELECT {SYSTEM} AS system, 'Raw 1-minute grid' AS stage, raw AS m FROM ms UNION ALL SELECT {SYSTEM}, 'After cleaning', after_cleaning FROM ms)
SELECT system, stage, CAST(floor(m / 0.025 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM lo WHERE m IS NOT NULL GROUP BY ALL"""
)
def q5_missingness_histogram(spark, sf):
    return report.missingness_histogram(missingness(spark, sf).select(system_of().alias("system"), F.concat_ws("||", *SERIES).alias("feature"), "raw", "after_cleaning"))


@query(f", {MISSING}, hv AS (SELECT day, t, component, kpi, last_value(value IGNORE NULLS) OVER (PARTITION BY component, kpi, day ORDER BY t ROWS UNBOUNDED PRECEDING) AS v, seen_at FROM hd), fl AS (SELECT hv.*, CASE WHEN t - seen_at <= lim THEN v END AS filled FROM hv JOIN kp USING (component, kpi) JOIN lm USING (component, kpi)), md AS (SELECT component, kpi, median(filled) AS m FROM fl JOIN td USING (day) GROUP BY ALL) SELECT day, t, component, kpi, round(coalesce(filled, m, 0), 6) AS clean FROM fl LEFT JOIN md USING (component, kpi)")
def prepared_fold(spark, sf):
    return clean.cleaned(kept(T.grid(spark, sf)), T.train_days(spark, sf)).select("day", "t", *SERIES, r6("clean").alias("clean"))


@query(
    f""", {BASE}, f1 AS (SELECT system, component, reason, onset, day, t FROM fb QUALIFY row_number() OVER (PARTITION BY system ORDER BY onset, event_id) = 1),
wd AS (SELECT f1.*, m.kpi, CAST(m.t - f1.t AS INTEGER) AS minute, m.value FROM mn m JOIN f1 ON m.day = f1.day AND m.component = f1.component AND m.t BETWEEN f1.t - 6 AND f1.t + 6),
cu AS (SELECT system, floor(min(minute) / 2) AS cut FROM wd GROUP BY system),
hf AS (SELECT system, kpi, min(value) AS low, max(value) - min(value) AS range, avg(value) FILTER (minute < cut) AS a, avg(value) FILTER (minute < 0 AND minute >= cut) AS b FROM wd JOIN cu USING (system) GROUP BY ALL),
bt AS (SELECT *, CASE WHEN range > 0 THEN coalesce(abs(b - a) / range, 0) ELSE 0 END AS contrast FROM hf QUALIFY row_number() OVER (PARTITION BY system ORDER BY contrast DESC, kpi) <= 4)
SELECT system, component, reason, strftime(onset, '%Y-%m-%d %H:%M:%S') AS onset, kpi, minute, round((value - low) / CASE WHEN range > 0 THEN range ELSE 1 END, 6) AS value,
 component || ', ' || reason || ' (' || strftime(onset, '%Y-%m-%d %H:%M:%S') || ')' AS panel FROM wd JOIN bt USING (system, kpi)"""
)
def q6_closeup_panels(spark, sf):
    f = faults(spark, sf)
    panels = []
    for system in ("Bank", "Telecom"):
        first = f.where(F.col("system") == system).orderBy("onset", "event_id").limit(1).select("system", F.col("component").alias("_of"), "reason", F.date_format("onset", "yyyy-MM-dd HH:mm:ss").alias("onset"), "day", "t")
        window = explore.around(first, T.means(spark, sf).select("day", "t", *SERIES, "value"), 6, 6).where("component = _of")
        best = explore.closeup(window, SERIES)
        panels.append(best.select("system", "component", "reason", "onset", "kpi", "minute", r6("scaled").alias("value")))
    return report.closeup_panels(reduce(DataFrame.unionByName, panels))


QUIET = f"""{BASE},
sp AS (SELECT component, kpi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM mn JOIN td USING (day) GROUP BY ALL HAVING q > 1e-9),
tm AS (SELECT DISTINCT system, 'fault' AS kind, reason, day, t FROM fb
  UNION ALL SELECT s.system, 'random', '', dy.day, bk.t FROM (SELECT unnest(['Bank', 'Telecom']) AS system) s CROSS JOIN dy CROSS JOIN bk
  WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.system = s.system AND abs((datediff('day', fb.day, dy.day) * 48 + bk.t) - fb.t) <= 9)),
nr AS (SELECT tm.*, m.component AS mc, m.kpi, CAST(m.t - tm.t AS INTEGER) AS minute, m.value / q AS value FROM tm JOIN (SELECT *, {SYSTEM} AS ms FROM mn) m ON m.ms = tm.system AND m.day = tm.day AND m.t BETWEEN tm.t - 6 AND tm.t + 3
  JOIN sp ON sp.component = m.component AND sp.kpi = m.kpi WHERE tm.t >= 6 AND tm.t + 3 <= 47),
bs AS (SELECT system, kind, reason, day, t, mc, kpi, median(value) AS base FROM nr WHERE minute <= -4 GROUP BY ALL),
pf AS (SELECT system, kind, reason, CAST(datediff('day', DATE '1970-01-01', day) AS BIGINT) * 48 + t AS onset, minute, avg(least(abs(value - base), 10)) AS change FROM nr JOIN bs USING (system, kind, reason, day, t, mc, kpi) GROUP BY ALL)"""


def profiles(spark, sf) -> DataFrame:
    """system, kind, reason, onset, minute, change: around each fault, and around every bucket far from all faults of its system."""
    f = faults(spark, sf)
    onsets = f.select("system", F.lit("fault").alias("kind"), "reason", "day", "t").distinct()
    cells = T.days(spark, sf).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(T.BUCKETS - 1)))).withColumn("row", T.row_of("day", "t"))
    quiet = [explore.quiet_times(cells, f.where(F.col("system") == s).select(T.row_of("day", "t").alias("row")), 9).select(F.lit(s).alias("system"), F.lit("random").alias("kind"), F.lit("").alias("reason"), "day", "t") for s in ("Bank", "Telecom")]
    times = explore.whole_windows(onsets.unionByName(quiet[0]).unionByName(quiet[1]), T.BUCKETS, 6, 3).withColumn("onset", T.row_of("day", "t"))
    means = kept(T.means(spark, sf))  # several plans read it
    fit = features.robust_fit(means.join(F.broadcast(T.train_days(spark, sf)), "day", "left_semi"))
    values = explore.by_spread(means, fit, SERIES).select("day", "t", F.col("component").alias("mc"), "kpi", "scaled", system_of().alias("of"))
    ids = ["system", "kind", "reason", "onset"]
    near = explore.around(times, values, 6, 3).where("of = system")
    base = near.where("minute <= -4").groupBy(*ids, "mc", "kpi").agg(F.percentile("scaled", F.lit(0.5)).alias("_base"))
    return near.join(base, [*ids, "mc", "kpi"]).groupBy(*ids, "minute").agg(F.avg(clip(F.abs(F.col("scaled") - F.col("_base")), 0.0, 10.0)).alias("change"))


@query(
    f""", {QUIET}, g AS (SELECT system, CASE WHEN kind = 'fault' THEN 'Around a fault start' ELSE 'Random fault-free time' END AS kind, minute, avg(change) AS mean, stddev_samp(change) / sqrt(count(*)) AS se FROM pf GROUP BY ALL)
SELECT system, kind, minute, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high FROM g"""
)
def q7_profile_band(spark, sf):
    band = report.profile_band(profiles(spark, sf))
    return band.withColumns({c: r6(c) for c in ("mean", "se", "low", "high")})


@query(
    f""", {QUIET}, ph AS (SELECT system, reason, CASE WHEN minute < -3 THEN 'base' WHEN minute < 0 THEN 'pre' WHEN minute <= 1 THEN 'onset' ELSE 'later' END AS period, avg(change) AS c FROM pf WHERE kind = 'fault' GROUP BY ALL),
wi AS (SELECT system, reason, max(c) FILTER (period = 'base') AS b, max(c) FILTER (period = 'pre') AS p, max(c) FILTER (period = 'onset') AS o FROM ph GROUP BY ALL)
SELECT system, reason, (SELECT count(DISTINCT onset) FROM pf WHERE kind = 'fault' AND pf.system = wi.system AND pf.reason = wi.reason) AS faults, coalesce(printf('%+.3f', round(p - b, 3)), 'NA') AS before_start, coalesce(printf('%+.3f', round(o - b, 3)), 'NA') AS after_start FROM wi"""
)
def q8_change_by_type(spark, sf):
    return report.change_by_type(profiles(spark, sf), -3, 1)


ROUNDED = ("base_rate", "pr_auc", "pr_auc_lo", "pr_auc_hi", "roc_auc", "pr_lift", "precision", "recall", "f1", "event_recall", "false_alarms_per_day")


@query(
    f""", {METRICS} SELECT system, run, horizon, tp, fp, fn, tn, n_events, events_detected, median_lead_min, test_days, round(base_rate, 6) AS base_rate, round(pr_auc, 6) AS pr_auc, round(pr_auc_lo, 6) AS pr_auc_lo, round(pr_auc_hi, 6) AS pr_auc_hi,
 round(roc_auc, 6) AS roc_auc, round(pr_lift, 6) AS pr_lift, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(event_recall, 6) AS event_recall, round(false_alarms_per_day, 6) AS false_alarms_per_day FROM mt"""
)
def run_metrics(spark, sf):
    return metrics(spark, sf).withColumns({c: r6(c) for c in ROUNDED})


@query(f", {METRICS} SELECT system, run, fold, horizon, event_id, component, reason, row, CAST(lead AS INTEGER) AS lead_min, lead IS NOT NULL AS detected FROM ed JOIN (SELECT event_id, component, reason FROM fb) USING (event_id)")
def run_events(spark, sf):
    return events(spark, sf)


F2 = "coalesce(printf('%.2f', round({0}, 2)), 'NA')"
F3 = "coalesce(printf('%.3f', round({0}, 3)), 'NA')"


@query(
    f""", {METRICS} SELECT system, run, horizon, round_even(base_rate, 3) AS base_rate, {F3.format("pr_auc")} || ' [' || {F3.format("pr_auc_lo")} || ', ' || {F3.format("pr_auc_hi")} || ']' AS pr_auc, coalesce(printf('%.2f', round(pr_lift, 2)), 'NA') AS lift,
 round_even(roc_auc, 3) AS roc_auc, printf('%.1f%%', round(100.0 * (tp + fp) / (tp + fp + fn + tn), 1)) AS alarmed, events_detected || ' / ' || n_events AS caught, round_even(false_alarms_per_day, 1) AS false_alarms_per_day FROM mt"""
)
def q9_metrics_table(spark, sf):
    return report.metrics_table(metrics(spark, sf), predicted(spark, sf), ("system", "run"))


TIMED = "CAST(datediff('day', DATE '1970-01-01', pd.day) AS BIGINT) * 86400 + pd.t * 1800"


def timeline(spark, sf):
    p = predicted(spark, sf).where("system = 'Bank' and run = 'chrono-level'").withColumn("timestamp", T.row_of("day", "t") * 1800)
    table = p.select("horizon", "threshold").distinct()
    return report.timeline(p.drop("threshold", "day"), table, faults(spark, sf), "Bank", "2024-01-15", horizon=3, offset=0)


@query(f", {PREDICTED} SELECT strftime(to_timestamp({TIMED}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS time, strftime(pd.day, '%m-%d') AS day, y, score, threshold, alarm FROM pd WHERE system = 'Bank' AND run = 'chrono-level' AND horizon = 3")
def q11_timeline(spark, sf):
    scores, _ = timeline(spark, sf)
    return scores.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "day", "y", "score", "threshold", "alarm")


@query(f", {BASE} SELECT component, reason, day, t, strftime(onset, '%m-%d') AS label FROM fb WHERE system = 'Bank' AND day >= DATE '2024-01-15'")
def q11_onsets(spark, sf):
    _, onsets = timeline(spark, sf)
    return onsets.select("component", "reason", "day", "t", "label")


DRIFT = f"""{BASE},
ua AS (SELECT mn.component, mn.kpi, mn.day, mn.t, mn.value, lu.y FROM (SELECT *, {SYSTEM} AS system FROM mn) mn JOIN lu ON lu.system = mn.system AND lu.day = mn.day AND lu.t = mn.t AND lu.horizon = 3 JOIN td ON td.day = mn.day),
dd AS (SELECT component, kpi, y, value - avg(value) OVER (PARTITION BY component, kpi, day) AS x FROM ua),
dc AS (SELECT component, kpi, y, x - avg(x) OVER (PARTITION BY component, kpi) AS x FROM dd),
dg AS (SELECT component, kpi, y, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM dc GROUP BY ALL),
df AS (SELECT {SYSTEM} AS system, component, kpi, CASE WHEN count(*) = 2 AND sum(ss) - sum(s * s / n) > 1e-14 * sum(ss) THEN (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / ((sum(ss) - sum(s * s / n)) / (sum(n) - 2)) ELSE 0 END AS f FROM dg GROUP BY ALL),
dt4 AS (SELECT system, component, kpi FROM df QUALIFY row_number() OVER (PARTITION BY system ORDER BY f DESC, component, kpi) <= 4),
ft AS (SELECT component, kpi, quantile_cont(value, 0.5) AS m, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-9 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END AS q FROM ua GROUP BY ALL),
rt AS (SELECT system, day, avg(y) AS rate FROM lu WHERE horizon = 3 GROUP BY ALL),
dr AS (SELECT d.system, mn.day, split, component || '||' || kpi AS feature, (avg(value) - any_value(m)) / any_value(q) AS scaled_mean, any_value(rate) AS positive_rate
  FROM mn JOIN dt4 d USING (component, kpi) JOIN ft USING (component, kpi) JOIN ch ON ch.day = mn.day LEFT JOIN rt ON rt.system = d.system AND rt.day = mn.day GROUP BY d.system, mn.day, split, component, kpi)"""


def drift(spark, sf) -> DataFrame:
    """system, day, split, feature, scaled_mean, positive_rate of each system's four most telling series."""
    means, train, lab = kept(T.means(spark, sf)), F.broadcast(T.train_days(spark, sf)), usable(spark, sf).where("horizon = 3")
    rows = means.withColumn("system", system_of()).join(lab, ["system", "day", "t"]).join(train, "day", "left_semi").select(*SERIES, "system", "day", "value", "y")
    fit = features.robust_fit(rows)
    out = []
    for system in ("Bank", "Telecom"):
        top = explore.top_drift(rows.where(F.col("system") == system).select(*SERIES, "day", "value", "y"), SERIES)
        rated_ = lab.where(F.col("system") == system).withColumn("usable", F.lit(True))
        out.append(explore.drift(means.join(top, SERIES, "left_semi"), fit, rated_, T.chrono(spark, sf), SERIES).withColumn("system", F.lit(system)))
    return reduce(DataFrame.unionByName, out).withColumn("feature", F.concat_ws("||", *SERIES)).drop(*SERIES)


@query(f", {DRIFT} SELECT system, strftime(day, '%m-%d') AS label, split, replace(feature, '||', ': ') AS feature, round(scaled_mean, 6) AS scaled_mean, round(positive_rate, 6) AS positive_rate, CAST(dense_rank() OVER (ORDER BY strftime(day, '%m-%d')) AS INTEGER) AS x FROM dr")
def q12_drift(spark, sf):
    coded, _ = report.drift_table(drift(spark, sf), r"\|\|")
    return coded.select("system", "label", "split", "feature", r6("scaled_mean").alias("scaled_mean"), r6("positive_rate").alias("positive_rate"), "x")


@query(f", {DRIFT} SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY strftime(day, '%m-%d')) AS INTEGER) AS x, strftime(day, '%m-%d') AS label, split FROM dr")
def q12_bands(spark, sf):
    return report.drift_table(drift(spark, sf), r"\|\|")[1]


RUNS = "CASE run WHEN " + " WHEN ".join(f"'{k}' THEN '{v}'" for k, v in report.RUNS.items()) + " END"
ORDER = "CASE run WHEN " + " WHEN ".join(f"'{k}' THEN {i}" for i, k in enumerate(report.RUNS)) + " END"


@query(f", {METRICS} SELECT system, {RUNS} AS run, {ORDER} AS run_order, horizon, round(pr_lift, 6) AS pr_lift, round(pr_auc_lo / base_rate, 6) AS lift_lo, round(pr_auc_hi / base_rate, 6) AS lift_hi FROM mt")
def q13_lift_by_run(spark, sf):
    labelled = metrics(spark, sf).withColumns({"run_order": F.expr(ORDER), "run": F.expr(RUNS)})
    return report.lift_by_run(labelled, ("system",)).withColumns({c: r6(c) for c in ("pr_lift", "lift_lo", "lift_hi")})


@query(
    f""", {METRICS} SELECT system, {F2.format('min(pr_lift)')} || ' to ' || {F2.format('max(pr_lift)')} AS lift_range, {F2.format('min(roc_auc)')} || ' to ' || {F2.format('max(roc_auc)')} AS roc_range,
 count(*) FILTER (pr_auc_lo > base_rate) || ' of ' || count(*) AS above_base, min_by(n_events, horizon) AS test_faults FROM mt WHERE run = 'chrono-level' GROUP BY system"""
)
def q20_compare_systems(spark, sf):
    return report.compare_systems(metrics(spark, sf).where("run = 'chrono-level'"))
