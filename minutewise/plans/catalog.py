"""Every query over the driver's tables, by name, beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutewise.functions import scalars as S
from minutewise.operators import clean, evaluate, explore, features, labels
from minutewise.operators.grid import lengthen, widen
from minutewise.operators.stage import kept
from minutewise.plans import telemetry as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SERIES = T.SERIES


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {T.SQL}{sql}" if base else sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def bootstrap_sql(source: str, keys: list[str], to: str, reps: int = 300, block: int = 60, seed: int = 20260916) -> str:
    """Common table expressions up to `to` (keys, pr_auc_lo, pr_auc_hi) for a source of keys, i, y, score."""
    k, on = ", ".join(keys), " AND ".join(f"d.{c} = s.{c}" for c in keys)
    return f"""{to}_n AS (SELECT {k}, count(*) AS n_rows, min(y) < max(y) AS two FROM {source} GROUP BY ALL),
{to}_b AS (SELECT {k}, n_rows, rep, unnest(range(greatest(1, n_rows // {block}))) AS b FROM (SELECT *, unnest(range({reps})) AS rep FROM {to}_n)),
{to}_d AS (SELECT *, (v * v + u) % 2147483647 % greatest(1, n_rows - {block} + 1) AS start FROM (SELECT *, (u * u + 12345) % 2147483647 AS v FROM (SELECT *, (rep * 40692 + b * 48271 + {seed}) % 2147483647 AS u FROM {to}_b))),
{to}_t AS (SELECT {", ".join(f"d.{c}" for c in keys)}, rep, score, count(*) AS n, sum(y) AS p FROM {to}_d d JOIN {source} s ON {on} AND s.i >= d.start AND s.i < d.start + {block} GROUP BY ALL),
{to}_c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY {k}, rep) AS tp, sum(n) OVER (PARTITION BY {k}, rep) AS tn FROM {to}_t WINDOW w AS (PARTITION BY {k}, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{to}_a AS (SELECT {k}, rep, sum(p / tp * cp / cn) AS ap FROM {to}_c WHERE tp > 0 AND tp < tn GROUP BY ALL),
{to} AS (SELECT n.*, lo AS pr_auc_lo, hi AS pr_auc_hi FROM {to}_n n LEFT JOIN (SELECT {k}, quantile_cont(ap, 0.025) AS lo, quantile_cont(ap, 0.975) AS hi FROM {to}_a GROUP BY ALL) USING ({k}))"""


# Fault record and report tables


@query("SELECT component, rank, event_id, reason, day FROM (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS INTEGER) AS rank FROM fa) WHERE rank <= 3")
def fault_first3(spark, sf):
    w = Window.partitionBy("component").orderBy("ts", "event_id")
    return T.faults(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("component", "rank", "event_id", "reason", "day")


@query("SELECT component, reason, n AS faults, round(n / sum(n) OVER (PARTITION BY component), 6) AS share FROM (SELECT component, reason, count(*) AS n FROM fa GROUP BY ALL)")
def fault_share(spark, sf):
    n = T.faults(spark, sf).groupBy("component", "reason").agg(F.count("*").alias("faults"))
    total = F.sum("faults").over(Window.partitionBy("component"))
    return n.withColumn("share", r6(F.col("faults") / total)).orderBy("component", F.desc("faults"), "reason")


@query(
    "SELECT component, count(*) AS days_with_faults, min(n) AS min_per_day, max(n) AS max_per_day, CAST(sum(n) AS BIGINT) AS total FROM (SELECT component, day, count(*) AS n FROM fa GROUP BY ALL) GROUP BY component"
)
def faults_per_day_summary(spark, sf):
    n = T.faults(spark, sf).groupBy("component", "day").agg(F.count("*").alias("n"))
    return n.groupBy("component").agg(F.count("*").alias("days_with_faults"), F.min("n").alias("min_per_day"), F.max("n").alias("max_per_day"), F.sum("n").alias("total"))


@query(
    "SELECT c.component, d.day, coalesce(n, 0) AS faults, strftime(d.day, '%m-%d') AS label FROM dy d CROSS JOIN (SELECT DISTINCT component FROM fa) c LEFT JOIN (SELECT component, day, count(*) AS n FROM fa GROUP BY ALL) f ON f.component = c.component AND f.day = d.day"
)
def faults_per_day_zero_fill(spark, sf):
    f = T.faults(spark, sf)
    # The recorded days come as one joined string, as in the split table, and are split again.
    listed = T.days(spark, sf).agg(F.array_join(F.array_sort(F.collect_list(F.col("day").cast("string"))), ", ").alias("days"))
    recorded = listed.select(F.explode(F.split("days", ", ")).alias("day")).select(F.to_date("day").alias("day"))
    every = recorded.crossJoin(f.select("component").distinct())
    n = f.groupBy("component", "day").agg(F.count("*").alias("faults"))
    return every.join(n, ["component", "day"], "left").select("component", "day", F.coalesce("faults", F.lit(0)).alias("faults"), F.date_format("day", "MM-dd").alias("label"))


# Grid and reshaping


@query("SELECT day, t, component, kpi, round(value, 6) AS value, n FROM mn")
def grid_mean(spark, sf):
    return T.means(spark, sf).withColumn("value", r6("value"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "SELECT l_returnflag, measure, count(value) AS n, round(avg(value), 4) AS mean FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME measure VALUE value) GROUP BY ALL",
    base=False,
)
def wide_unpivot(spark, sf):
    wide = T.table(spark, sf, "lineitem").select("l_returnflag", *MEASURES)
    return lengthen(wide, ["l_returnflag"], MEASURES, "measure", "value").groupBy("l_returnflag", "measure").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT day, t, component, kpi, round(value, 6) AS value FROM gr")
def grid_reindex(spark, sf):
    return T.grid(spark, sf).select("day", "t", *SERIES, r6("value").alias("value"))


@query(
    "SELECT day, round(avg(value) FILTER (kpi = 'click'), 6) AS click, round(avg(value) FILTER (kpi = 'purchase'), 6) AS purchase, round(avg(value) FILTER (kpi = 'view'), 6) AS view FROM mn GROUP BY day"
)
def pivot_wide(spark, sf):
    kinds = ["click", "purchase", "view"]
    out = widen(T.means(spark, sf), ["day"], "kpi", kinds, "value", F.avg)
    return out.select("day", *(r6(k).alias(k) for k in kinds))


PERIOD = "CASE WHEN t < 12 THEN 'night' WHEN t < 24 THEN 'morning' WHEN t < 36 THEN 'day' ELSE 'evening' END"


@query(
    f"SELECT component, round(avg(value) FILTER (p = 'night'), 6) AS night, round(avg(value) FILTER (p = 'morning'), 6) AS morning, round(avg(value) FILTER (p = 'day'), 6) AS day, round(avg(value) FILTER (p = 'evening'), 6) AS evening FROM (SELECT *, {PERIOD} AS p FROM mn) GROUP BY component"
)
def pivot_period(spark, sf):
    p = T.means(spark, sf).withColumn("p", F.expr(PERIOD)).groupBy("component", "p").agg(r6(F.avg("value")).alias("change"))
    return widen(p, ["component"], "p", ["night", "morning", "day", "evening"], "change")


@query("SELECT 'customer' AS source, c_nationkey AS nation, round(sum(c_acctbal), 2) AS balance, count(*) AS n FROM customer GROUP BY ALL UNION ALL BY NAME SELECT 'supplier' AS source, s_nationkey AS nation, round(sum(s_acctbal), 2) AS balance, count(*) AS n FROM supplier GROUP BY ALL", base=False)
def union_by_name(spark, sf):
    c = T.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    s = T.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("source", "nation").agg(F.round(F.sum("bal"), 2).alias("balance"), F.count("*").alias("n"))


# Cleaning


@query("SELECT component, kpi, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM gr GROUP BY ALL")
def missing_share(spark, sf):
    return clean.missing_share(T.grid(spark, sf)).withColumn("missing", r6("missing"))


@query(
    "SELECT component, kpi FROM (SELECT DISTINCT 'c' || (user_id % 40) AS component, event_type AS kpi, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error') JOIN td USING (day) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM td)"
)
def observed_every_day(spark, sf):
    return clean.observed_every_day(T.means(spark, sf, 40), T.train_days(spark, sf))


GAPS = "gp AS (SELECT component, kpi, t - lag(t) OVER (PARTITION BY component, kpi, day ORDER BY t) AS gap FROM gr JOIN td USING (day) WHERE value IS NOT NULL), lm AS (SELECT component, kpi, coalesce(median(gap), 1.0) AS median_gap, CAST(greatest(2, 2 * floor(coalesce(median(gap), 1.0))) AS INTEGER) AS lim FROM gp GROUP BY ALL)"


def train_grid(spark, sf, grid=None):
    return (T.grid(spark, sf) if grid is None else grid).join(F.broadcast(T.train_days(spark, sf)), "day", "left_semi")


@query(f", {GAPS} SELECT component, kpi, median_gap, lim AS fill_limit FROM lm")
def gap_median(spark, sf):
    return clean.fill_limits(train_grid(spark, sf)).withColumnRenamed("limit", "fill_limit")


FILLED = "hd AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS v, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS seen_at FROM gr WINDOW w AS (PARTITION BY component, kpi, day ORDER BY t ROWS UNBOUNDED PRECEDING)), fl AS (SELECT day, t, component, kpi, value, CASE WHEN t - seen_at <= lim THEN v END AS filled FROM hd LEFT JOIN lm USING (component, kpi))"


@query(
    f", {GAPS}, {FILLED}, md AS (SELECT component, kpi, median(filled) AS m FROM fl JOIN td USING (day) GROUP BY ALL) SELECT day, t, component, kpi, round(filled, 6) AS filled, round(coalesce(filled, m, 0), 6) AS clean FROM fl LEFT JOIN md USING (component, kpi)"
)
def bounded_ffill(spark, sf):
    grid = kept(T.grid(spark, sf))  # three plans read it
    filled = clean.bounded_ffill(grid, clean.fill_limits(train_grid(spark, sf, grid)))
    return clean.fill_rest(filled, T.train_days(spark, sf)).select("day", "t", *SERIES, r6("filled").alias("filled"), r6("clean").alias("clean"))


@query(
    f""", {GAPS}, {FILLED},
ev AS (SELECT component, kpi, count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) = (SELECT count(*) FROM td) AS every_day, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM gr JOIN td USING (day) GROUP BY ALL),
kp AS (SELECT component, kpi FROM ev WHERE every_day AND missing <= 0.8)
SELECT (SELECT count(*) FROM ev) AS series_raw, (SELECT count(*) FROM ev WHERE NOT every_day) AS dropped_not_every_train_day, (SELECT count(*) FROM ev WHERE every_day AND missing > 0.8) AS dropped_over_80pct_missing,
 (SELECT count(*) FROM kp) AS series_kept,
 (SELECT round(avg(CASE WHEN filled IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM fl JOIN kp USING (component, kpi) JOIN td USING (day)) AS missing_after_ffill_train,
 (SELECT round(avg(CASE WHEN filled IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM fl JOIN kp USING (component, kpi)) AS missing_after_ffill_all"""
)
def prep_summary(spark, sf):
    out = clean.prep_summary(kept(T.grid(spark, sf)), T.train_days(spark, sf))
    return out.withColumns({c: r6(c) for c in ("missing_after_ffill_train", "missing_after_ffill_all")})


# Scaling and features


@query(
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, true AS moving FROM lineitem GROUP BY l_returnflag",
    base=False,
)
def robust_fit(spark, sf):
    fit = features.robust_fit(T.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return fit.select("l_returnflag", F.round("median", 4).alias("median"), F.round("iqr", 4).alias("iqr"), "moving")


@query(
    """SELECT l_orderkey, l_linenumber, round(greatest(least((l_extendedprice - m) / q, 10), -10), 6) AS scaled FROM lineitem JOIN
 (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS q FROM lineitem GROUP BY l_returnflag) USING (l_returnflag)""",
    base=False,
)
def robust_scale(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    fit = features.robust_fit(li, ["l_returnflag"], "l_extendedprice")
    return features.robust_scale(li, fit, ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


ANOVA = "SELECT measure, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(ss) - sum(s * s / n) AS w, sum(n) AS n FROM (SELECT measure, y, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM c GROUP BY ALL) GROUP BY measure"
LONG = "l AS (SELECT measure, value, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_shipdate AS DATE) AS day FROM (UNPIVOT (SELECT l_returnflag, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME measure VALUE value))"


def measures_long(spark, sf):
    li = T.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_shipdate").cast("date").alias("day"), *MEASURES, "l_tax")
    return lengthen(li, ["y", "day"], [*MEASURES, "l_tax"], "measure", "value")


TOP = "SELECT measure, round(f, 4) AS f, CAST(row_number() OVER (ORDER BY f DESC, measure) AS INTEGER) AS rank FROM (SELECT measure, b / (w / (n - 2)) AS f FROM a) QUALIFY rank <= 3"


@query(f"WITH {LONG}, c AS (SELECT measure, y, value - avg(value) OVER (PARTITION BY measure) AS x FROM l), a AS ({ANOVA}) {TOP}", base=False)
def anova_topk(spark, sf):
    f = features.anova_f(measures_long(spark, sf), ["measure"])
    return features.top_k(f, 3, ["measure"]).withColumn("f", F.round("f", 4))


@query(
    f"WITH {LONG}, d AS (SELECT measure, y, value - avg(value) OVER (PARTITION BY measure, day) AS x FROM l), c AS (SELECT measure, y, x - avg(x) OVER (PARTITION BY measure) AS x FROM d), a AS ({ANOVA}) {TOP}", base=False
)
def anova_within_day(spark, sf):
    within = features.demean(measures_long(spark, sf), ["measure", "day"])
    return features.top_k(features.anova_f(within, ["measure"]), 3, ["measure"]).withColumn("f", F.round("f", 4))


def bucket_scores(spark, sf):
    return T.readings(spark, sf).groupBy("day", "t").agg(F.round(F.avg("value"), 9).alias("score"))


@query()
def window_arrays(spark, sf):
    return features.look_back(bucket_scores(spark, sf), T.LOOKBACK, ["day"], "score")


@query(
    """, w AS (SELECT day, t, list(score) OVER (PARTITION BY day ORDER BY t ROWS 5 PRECEDING) AS w FROM sc)
SELECT day, t, w[6] AS last, round(list_avg(w), 7) AS mean, round(list_stddev_pop(w), 4) AS std, list_min(w) AS min, list_max(w) AS max, round(w[6] - w[1], 6) AS delta FROM w WHERE len(w) = 6"""
)
def window_stats(spark, sf):
    s = features.window_stats(window_arrays(spark, sf))
    return s.select("day", "t", "last", F.round("mean", 7).alias("mean"), F.round("std", 4).alias("std"), "min", "max", r6("delta").alias("delta"))


@query(
    """, w AS (SELECT day, t, list(score) OVER (PARTITION BY day ORDER BY t ROWS 5 PRECEDING) AS w FROM sc)
SELECT day, t, round(greatest(least(w[1] - list_median(w), 10), -10), 8) AS first, round(greatest(least(w[6] - list_median(w), 10), -10), 8) AS last FROM w WHERE len(w) = 6"""
)
def change_inputs(spark, sf):
    c = features.change_inputs(window_arrays(spark, sf))
    return c.select("day", "t", F.round(F.get("window", F.lit(0)), 8).alias("first"), F.round(F.element_at("window", -1), 8).alias("last"))


# Labels, folds, subsampling


@query("SELECT day, t, horizon, y, CAST(is_onset AS INTEGER) AS is_onset, usable FROM lb")
def label_mask(spark, sf):
    return T.labels(spark, sf, [1, 3, 6])


@query("SELECT horizon, count(*) FILTER (usable) AS usable, count(*) FILTER (usable AND y = 1) AS positive FROM lb GROUP BY horizon")
def usable_counts(spark, sf):
    return labels.usable_counts(T.labels(spark, sf, [1, 3, 6]), ["horizon"])


@query("SELECT fold, split, day FROM ch")
def folds_chrono(spark, sf):
    return T.chrono(spark, sf)


@query("SELECT fold, split, day FROM cf")
def folds_cv(spark, sf):
    return T.cv(spark, sf)


def labelled_folds(spark, sf):
    return T.labels(spark, sf, [1, 3, 6]).where("usable").join(T.cv(spark, sf), "day")


@query(
    "SELECT fold, horizon, positive, available, least(available, greatest(5 * positive, 50)) AS negative FROM (SELECT fold, horizon, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS available FROM lb JOIN cf USING (day) WHERE usable AND split = 'train' GROUP BY ALL)"
)
def neg_subsample_count(spark, sf):
    return labels.subsample_quota(labelled_folds(spark, sf).where("split = 'train'"), ["fold", "horizon"], least=50)


HASH = "CAST('0x' || substr(md5(day || '/' || t || '/20260916'), 1, 12) AS BIGINT)"


@query(
    f""", tn AS (SELECT fold, horizon, cf.day, t, y, {HASH.replace("md5(day", "md5(cf.day")} AS h FROM lb JOIN cf ON cf.day = lb.day WHERE usable AND split = 'train'),
qt AS (SELECT fold, horizon, greatest(5 * count(*) FILTER (y = 1), 50) AS quota FROM tn GROUP BY ALL),
rk AS (SELECT tn.*, row_number() OVER (PARTITION BY fold, horizon ORDER BY h % 4096, h, day, t) AS k FROM tn WHERE y = 0)
SELECT fold, horizon, day, t, y FROM tn WHERE y = 1 UNION ALL SELECT fold, horizon, day, t, y FROM rk JOIN qt USING (fold, horizon) WHERE k <= quota"""
)
def neg_subsample_rows(spark, sf):
    return labels.subsample_rows(labelled_folds(spark, sf).where("split = 'train'"), ["fold", "horizon"], ["day", "t"], 20260916, least=50).select("fold", "horizon", "day", "t", "y")


@query(
    """SELECT fold, split, horizon, string_agg(DISTINCT CAST(day AS VARCHAR), ', ' ORDER BY CAST(day AS VARCHAR)) AS days, count(*) AS windows, CAST(sum(y) AS BIGINT) AS positive, count(*) || ' x 6 x 16' AS shape,
 round(avg(CASE WHEN abs(score) >= 60 THEN 1.0 ELSE 0.0 END), 6) AS clipped_share FROM lb JOIN cf USING (day) JOIN sc USING (day, t) WHERE usable GROUP BY ALL"""
)
def split_summary(spark, sf):
    rows = labelled_folds(spark, sf).join(bucket_scores(spark, sf), ["day", "t"])
    return rows.groupBy("fold", "split", "horizon").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ", ").alias("days"),
        F.count("*").alias("windows"),
        F.sum("y").alias("positive"),
        F.concat_ws(" x ", F.count("*"), F.lit(6), F.lit(16)).alias("shape"),
        r6(features.clipped_share(rows, "score", 60.0)).alias("clipped_share"),
    )


# Ranking metrics


def scored_documents(spark, sf):
    return T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", F.col("quality").alias("y"), F.col("n_chars").alias("score"))


TIES = "s AS (SELECT lang, n_chars AS score, count(*) AS n, sum(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY ALL), c AS (SELECT *, sum(n) OVER d AS cn, sum(p) OVER d AS cp, sum(p) OVER (PARTITION BY lang) AS tp, sum(n) OVER (PARTITION BY lang) AS tn, sum(n) OVER u AS un FROM s WINDOW d AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY lang ORDER BY score ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {TIES} SELECT lang, CASE WHEN max(tp) > 0 THEN round(sum(p / tp * cp / cn), 6) END AS pr_auc FROM c GROUP BY lang", base=False)
def pr_auc(spark, sf):
    return evaluate.pr_auc(scored_documents(spark, sf), ["lang"]).withColumn("pr_auc", r6("pr_auc"))


@query(
    f"WITH {TIES} SELECT lang, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round((sum((un - (n - 1) / 2) * p) - max(tp) * (max(tp) + 1) / 2) / (max(tp) * (max(tn) - max(tp))), 6) END AS roc_auc FROM c GROUP BY lang", base=False
)
def roc_auc(spark, sf):
    return evaluate.roc_auc(scored_documents(spark, sf), ["lang"]).withColumn("roc_auc", r6("roc_auc"))


@query(
    """WITH s AS (SELECT lang, quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)), t AS (SELECT lang, CAST(trunc(quantile_cont(score, 1 - 30 / 1440.0)) AS BIGINT) AS threshold FROM s GROUP BY lang),
c AS (SELECT lang, any_value(threshold) AS threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y <> 1) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y <> 1) AS tn FROM s JOIN t USING (lang) GROUP BY lang)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp + fn) / (tp + fp + fn + tn), 6) AS base_rate FROM c""",
    base=False,
)
def threshold_confusion(spark, sf):
    s = scored_documents(spark, sf)
    cut = evaluate.thresholds(s, ["lang"])
    c = evaluate.confusion(s.join(cut, "lang").withColumn("alarm", F.col("score") >= F.col("threshold")), ["lang", "threshold"])
    return c.withColumns({k: r6(k) for k in ("precision", "recall", "f1", "base_rate")})


@query(
    f"""WITH s AS (SELECT doc_id % 5 AS g, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS i, quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)),
{bootstrap_sql("s", ["g"], "bt")} SELECT g, round(pr_auc_lo, 6) AS pr_auc_lo, round(pr_auc_hi, 6) AS pr_auc_hi FROM bt""",
    base=False,
)
def bootstrap_ci(spark, sf):
    s = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    ranked, n = evaluate.row_numbers(s.withColumn("g", F.col("doc_id") % 5), ["g"], "doc_id")
    out = evaluate.block_bootstrap(ranked.select("g", "i", F.col("quality").alias("y"), F.col("n_chars").alias("score")), ["g"], n)
    return out.withColumns({c: r6(c) for c in ("pr_auc_lo", "pr_auc_hi")})


# Events


EVENT = "ev AS (SELECT f.event_id, f.reason, CAST(datediff('day', DATE '1970-01-01', f.day) AS BIGINT) * 48 + f.t AS row FROM fa f), dt AS (SELECT event_id, reason, ev.row, CAST(max(ev.row - pr.row) AS INTEGER) AS lead, max(ev.row - pr.row) IS NOT NULL AS detected FROM ev LEFT JOIN pr ON pr.alarm AND pr.row BETWEEN ev.row - 3 AND ev.row - 1 GROUP BY ALL)"


def detections(spark, sf):
    on = T.faults(spark, sf).select("event_id", "reason", T.row_of("day", "t").alias("row"))
    return evaluate.event_detection(on, T.predictions(spark, sf), [], T.HORIZON)


@query(f", {EVENT} SELECT event_id, reason, row, lead, detected FROM dt")
def event_detection(spark, sf):
    return detections(spark, sf)


@query(f", {EVENT} SELECT reason, count(*) AS n_events, count(*) FILTER (detected) AS events_detected, round(avg(CAST(detected AS INTEGER)), 6) AS event_recall, median(lead) AS median_lead FROM dt GROUP BY reason")
def event_summary(spark, sf):
    return evaluate.event_summary(detections(spark, sf), ["reason"]).withColumn("event_recall", r6("event_recall"))


EPISODES = "ep AS (SELECT *, alarm AND y = 0 AS fa_now, lag(alarm AND y = 0) OVER w AS fa_before, lag(row) OVER w AS row_before FROM pr WINDOW w AS (PARTITION BY fold ORDER BY row)), st AS (SELECT * FROM ep WHERE fa_now AND NOT coalesce(fa_before AND row - row_before = 1, false))"


@query(f", {EPISODES} SELECT fold, day, t FROM st")
def false_alarm_episodes(spark, sf):
    return evaluate.false_alarm_episodes(T.predictions(spark, sf), ["fold", "day"]).select("fold", "day", "t")


@query(
    f""", {EPISODES}, pf AS (SELECT fold, count(DISTINCT day) AS test_days, count(*) FILTER (alarm AND y = 1) AS tp, count(*) FILTER (alarm AND y = 0) AS fp, count(*) FILTER (NOT alarm AND y = 1) AS fn, count(*) FILTER (NOT alarm AND y = 0) AS tn FROM pr GROUP BY fold),
fd AS (SELECT fold, count(*) AS starts FROM st GROUP BY fold)
SELECT 'pooled' AS fold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, round(sum(coalesce(starts, 0) / test_days * test_days) / sum(test_days), 6) AS false_alarms_per_day FROM pf LEFT JOIN fd USING (fold)"""
)
def pooled_metrics(spark, sf):
    p = T.predictions(spark, sf)
    by_fold = evaluate.confusion(p, ["fold"]).join(p.groupBy("fold").agg(F.count_distinct("day").alias("test_days")), "fold")
    starts = evaluate.false_alarm_episodes(p, ["fold", "day"]).groupBy("fold").agg(F.count("*").alias("starts"))
    rates = by_fold.join(starts, "fold", "left").withColumn("rate", F.coalesce("starts", F.lit(0)) / F.col("test_days"))
    return rates.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), r6(evaluate.weighted_mean("rate", "test_days")).alias("false_alarms_per_day")).withColumn("fold", F.lit("pooled"))


@query(
    """, pf AS (SELECT fold, avg(y) AS base, avg(CASE WHEN y = 1 THEN score END) AS hit, avg(CASE WHEN alarm THEN 1.0 ELSE 0.0 END) AS alarmed FROM pr GROUP BY fold)
SELECT 'run ' || fold AS run, round(base, 6) AS base_rate, round(hit / base, 4) AS lift, round((hit - 1) / base, 4) AS lift_lo, round((hit + 1) / base, 4) AS lift_hi, round(alarmed, 6) AS alarmed FROM pf"""
)
def lift_ci_by_run(spark, sf):
    p = T.predictions(spark, sf).groupBy("fold").agg(F.avg("y").alias("base"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("hit"), F.avg(F.col("alarm").cast("double")).alias("alarmed"))
    lift = lambda d: F.round((F.col("hit") + d) / F.col("base"), 4)
    return p.select(F.concat(F.lit("run "), "fold").alias("run"), r6("base").alias("base_rate"), lift(0).alias("lift"), lift(-1).alias("lift_lo"), lift(1).alias("lift_hi"), r6("alarmed").alias("alarmed"))


# Exploration


@query("SELECT l_returnflag, CAST(floor(l_discount / 0.025 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY ALL", base=False)
def histogram(spark, sf):
    li = T.table(spark, sf, "lineitem").where("l_discount is not null")
    return li.groupBy("l_returnflag", F.floor(F.col("l_discount") / 0.025 + 1e-9).alias("bin")).agg(F.count("*").alias("n"))


PROFILE = """sp AS (SELECT component, kpi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM mn JOIN td USING (day) GROUP BY ALL HAVING q > 1e-9),
tm AS (SELECT DISTINCT day, t, component, reason FROM fa WHERE t - 6 >= 0 AND t + 3 <= 47),
nr AS (SELECT tm.day, tm.t, tm.reason, tm.component, m.component AS mc, m.kpi, m.t - tm.t AS minute, m.value / sp.q AS value FROM tm JOIN mn m ON m.day = tm.day AND m.t BETWEEN tm.t - 6 AND tm.t + 3 JOIN sp ON sp.component = m.component AND sp.kpi = m.kpi),
bs AS (SELECT day, t, reason, component, mc, kpi, quantile_cont(value, 0.5) AS base FROM nr WHERE minute <= -4 GROUP BY ALL),
pf AS (SELECT day, t, reason, component, minute, avg(least(abs(value - base), 10)) AS change FROM nr JOIN bs USING (day, t, reason, component, mc, kpi) GROUP BY ALL)"""


def profile(spark, sf):
    times = explore.whole_windows(T.faults(spark, sf).select("day", "t", "component", "reason").distinct(), T.BUCKETS, 6, 3)
    ids = ["day", "onset", "component", "reason"]
    means = kept(T.means(spark, sf))  # several plans read it
    fit = features.robust_fit(means.join(F.broadcast(T.train_days(spark, sf)), "day", "left_semi"))
    values = explore.by_spread(means, fit, SERIES).select("day", "t", F.col("component").alias("mc"), "kpi", "scaled")
    return explore.onset_profile(times.withColumn("onset", F.col("t")), values, ids, ["mc", "kpi"], 6, 3, 4)


@query(f", {PROFILE} SELECT day, t AS onset, component, reason, CAST(minute AS INTEGER) AS minute, round(change, 9) AS change FROM pf")
def onset_profile(spark, sf):
    return profile(spark, sf).withColumn("change", F.round("change", 9))


@query(f", {PROFILE} SELECT CAST(minute AS INTEGER) AS minute, round(avg(change), 6) AS mean, round(avg(change) - 1.96 * stddev_samp(change) / sqrt(count(*)), 6) AS low, round(avg(change) + 1.96 * stddev_samp(change) / sqrt(count(*)), 6) AS high FROM pf GROUP BY minute")
def profile_ci(spark, sf):
    c = F.col("change")
    half = 1.96 * F.stddev_samp(c) / F.sqrt(F.count("*"))
    return profile(spark, sf).groupBy("minute").agg(r6(F.avg(c)).alias("mean"), r6(F.avg(c) - half).alias("low"), r6(F.avg(c) + half).alias("high"))


PHASE = "CASE WHEN minute < -3 THEN 'base' WHEN minute < 0 THEN 'pre' WHEN minute <= 1 THEN 'onset' ELSE 'later' END"


@query(
    f""", {PROFILE}, ph AS (SELECT reason, {PHASE} AS phase, avg(change) AS change FROM pf GROUP BY ALL)
SELECT reason, round(max(change) FILTER (phase = 'pre') - max(change) FILTER (phase = 'base'), 6) AS pre, round(max(change) FILTER (phase = 'onset') - max(change) FILTER (phase = 'base'), 6) AS onset,
 (SELECT count(*) FROM (SELECT DISTINCT day, t, component FROM pf p WHERE p.reason = ph.reason)) AS n FROM ph GROUP BY reason"""
)
def period_change(spark, sf):
    p = profile(spark, sf)
    by_phase = widen(p.withColumn("phase", F.expr(PHASE)).groupBy("reason", "phase").agg(F.avg("change").alias("change")), ["reason"], "phase", ["base", "pre", "onset", "later"], "change")
    n = p.groupBy("reason").agg(F.count_distinct("day", "onset", "component").alias("n"))
    return by_phase.join(n, "reason").select("reason", r6(F.col("pre") - F.col("base")).alias("pre"), r6(F.col("onset") - F.col("base")).alias("onset"), "n")


@query("SELECT day, t FROM dy CROSS JOIN bk WHERE NOT EXISTS (SELECT 1 FROM fa WHERE abs((datediff('day', fa.day, dy.day) * 48 + bk.t) - fa.t) <= 4)")
def quiet_times(spark, sf):
    from minutewise.operators.grid import exact_grid

    cells = exact_grid(T.days(spark, sf), T.BUCKETS).withColumn("row", T.row_of("day", "t"))
    on = T.faults(spark, sf).select(T.row_of("day", "t").alias("row"))
    return explore.quiet_times(cells, on, 4).select("day", "t")


@query(
    f"SELECT day, t FROM dy CROSS JOIN bk WHERE NOT EXISTS (SELECT 1 FROM fa WHERE abs((datediff('day', fa.day, dy.day) * 48 + bk.t) - fa.t) <= 4) ORDER BY {HASH}, day, t LIMIT 300"
)
def quiet_sample(spark, sf):
    return explore.sample_rows(quiet_times(spark, sf), ["day", "t"], 300, 20260916)


@query(
    """, f1 AS (SELECT day, t, component FROM fa ORDER BY ts, event_id LIMIT 1), wd AS (SELECT m.component, m.kpi, CAST(m.t - f1.t AS INTEGER) AS minute, m.value FROM mn m JOIN f1 ON m.day = f1.day AND m.component = f1.component AND m.t BETWEEN f1.t - 6 AND f1.t + 6),
cu AS (SELECT floor(min(minute) / 2) AS cut FROM wd),
hf AS (SELECT component, kpi, min(value) AS low, max(value) - min(value) AS range, avg(value) FILTER (minute < cut) AS a, avg(value) FILTER (minute < 0 AND minute >= cut) AS b FROM wd, cu GROUP BY ALL),
bt AS (SELECT *, CASE WHEN range > 0 THEN coalesce(abs(b - a) / range, 0) ELSE 0 END AS contrast FROM hf ORDER BY contrast DESC, component, kpi LIMIT 4)
SELECT component, kpi, minute, round((value - low) / CASE WHEN range > 0 THEN range ELSE 1 END, 6) AS scaled FROM wd JOIN bt USING (component, kpi)"""
)
def closeup(spark, sf):
    first = T.faults(spark, sf).orderBy("ts", "event_id").select("day", "t", F.col("component").alias("_of")).limit(1)
    window = explore.around(first, T.means(spark, sf).select("day", "t", *SERIES, "value"), 6, 6).where("component = _of").drop("_of")
    return explore.closeup(window, SERIES).select(*SERIES, "minute", r6("scaled").alias("scaled"))


DRIFT = """fit AS (SELECT component, kpi, quantile_cont(value, 0.5) AS m, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-9 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END AS q FROM mn JOIN td USING (day) GROUP BY ALL),
dm AS (SELECT day, component, kpi, avg(value) AS v FROM mn GROUP BY ALL), rt AS (SELECT day, avg(y) AS rate FROM lb WHERE usable AND horizon = 3 GROUP BY day)"""


@query(f", {DRIFT} SELECT dm.day, split, component, kpi, round((v - m) / q, 6) AS scaled_mean, round(rate, 6) AS positive_rate FROM dm JOIN fit USING (component, kpi) LEFT JOIN rt USING (day) JOIN ch USING (day)")
def drift(spark, sf):
    means = kept(T.means(spark, sf))  # several plans read it
    fit = features.robust_fit(means.join(F.broadcast(T.train_days(spark, sf)), "day", "left_semi"))
    d = explore.drift(means, fit, T.labels(spark, sf), T.chrono(spark, sf), SERIES)
    return d.withColumns({"scaled_mean": r6("scaled_mean"), "positive_rate": r6("positive_rate")})


@query("SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY strftime(day, '%m-%d')) AS INTEGER) AS x, strftime(day, '%m-%d') AS label, split FROM ch")
def drift_bands(spark, sf):
    d = T.chrono(spark, sf).withColumn("label", F.date_format("day", "MM-dd"))
    return d.withColumn("x", F.dense_rank().over(Window.orderBy("label"))).select("x", "label", "split").distinct()


@query(
    "SELECT component, count(*) AS runs, round(avg(lift), 6) AS mean_lift, round(stddev_samp(lift), 6) AS sd_lift, round(min(lift), 6) AS min_lift, round(max(lift), 6) AS max_lift FROM (SELECT component, day, max(value) / avg(value) AS lift FROM mn GROUP BY ALL) GROUP BY component"
)
def seed_stability(spark, sf):
    lift = T.means(spark, sf).groupBy("component", "day").agg((F.max("value") / F.avg("value")).alias("lift"))
    x = F.col("lift")
    return lift.groupBy("component").agg(F.count("*").alias("runs"), r6(F.avg(x)).alias("mean_lift"), r6(F.stddev_samp(x)).alias("sd_lift"), r6(F.min(x)).alias("min_lift"), r6(F.max(x)).alias("max_lift"))


@query(
    "SELECT component, count(*) FILTER (lo > base) AS above, count(*) AS n, min_by(n0, t) AS first_n FROM (SELECT component, t, min(value) AS lo, avg(n) AS base, CAST(sum(n) AS BIGINT) AS n0 FROM mn GROUP BY ALL) GROUP BY component"
)
def system_summary(spark, sf):
    by_t = T.means(spark, sf).groupBy("component", "t").agg(F.min("value").alias("lo"), F.avg("n").alias("base"), F.sum("n").alias("n0"))
    return by_t.groupBy("component").agg(F.count_if(F.col("lo") > F.col("base")).alias("above"), F.count("*").alias("n"), F.min_by("n0", "t").alias("first_n"))


# Functions


@query(
    """SELECT p_partkey, p_brand || '||' || p_type AS series, p_brand AS component, p_type AS kpi, left(p_brand, 3) AS prefix, regexp_extract(p_type, '^[^ ]+', 0) AS first_word, regexp_replace(p_type, '^[^ ]+ ', '') AS rest,
 replace(p_type, ' ', ': ') AS replaced, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS title, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS size_class FROM part""",
    base=False,
)
def string_funcs(spark, sf):
    p = T.table(spark, sf, "part")
    series = S.series_name(F.col("p_brand"), F.col("p_type"))
    return p.select(
        "p_partkey",
        series.alias("series"),
        S.series_component(series).alias("component"),
        S.series_kpi(series).alias("kpi"),
        F.substring("p_brand", 1, 3).alias("prefix"),
        F.regexp_extract("p_type", "^[^ ]+", 0).alias("first_word"),
        F.regexp_replace("p_type", "^[^ ]+ ", "").alias("rest"),
        F.regexp_replace("p_type", " ", ": ").alias("replaced"),
        S.title_case(F.col("p_brand")).alias("title"),
        F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large").alias("size_class"),
    )


@query(
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + 28800 AS local_second, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, strftime(ts + INTERVAL 8 HOUR, '%m-%d') AS label, CAST((hour(ts) * 60 + minute(ts)) AS INTEGER) AS minute FROM events", base=False
)
def ts_funcs(spark, sf):
    e = T.table(spark, sf, "events")
    local = F.expr("ts + interval 8 hours")
    second = F.unix_date(F.col("ts").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return e.select("event_id", (second + 28800).alias("local_second"), local.cast("date").alias("local_day"), F.date_format(local.cast("date"), "MM-dd").alias("label"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))


@query(
    "SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice / 1000 - 30, 10), -10), 6) AS clipped, round(sqrt(abs(l_tax - l_discount)), 6) AS root, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS sig, round(tanh(l_discount), 6) AS th, round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0 END, 6) AS ratio, CAST(floor((l_linenumber - 4) / 2) AS BIGINT) AS half FROM lineitem",
    base=False,
)
def math_funcs(spark, sf):
    c = F.col
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r6(S.clip(c("l_extendedprice") / 1000 - 30, -10.0, 10.0)).alias("clipped"), r6(F.sqrt(F.abs(c("l_tax") - c("l_discount")))).alias("root"), r6(S.sigmoid((c("l_quantity") - 25) / 10)).alias("sig"),
        r6(F.tanh("l_discount")).alias("th"), r6(S.safe_divide(c("l_discount"), c("l_tax"))).alias("ratio"), S.floor_div(c("l_linenumber") - 4, 2).alias("half"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm, round(list_median(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS middle FROM embeddings", base=False)
def dot_product(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(S.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"), F.round(S.array_median(F.transform("embedding", lambda x: x.cast("double"))), 9).alias("middle"))
