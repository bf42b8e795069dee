"""The report's queries over fault records and result tables, Q1 to Q20; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutewise.functions.scalars import interval, percent, series_component, series_kpi, shown, signed, title_case

#: Run names with their labels, and the prefixes that are cut from metric names. The other strings of this
#: module (labels of stages, kinds, metrics and settings) are the report's too.
RUNS = {"chrono-level": "Chronological, level", "chrono-change": "Chronological, change", "cv-level": "Cross-validation, level", "cv-change": "Cross-validation, change"}
KPI_PREFIXES = r"^OSLinux-OSLinux_|^Mysql-MySQL_3306_|^redis-Redis_6379_"


def both(bank: DataFrame, telecom: DataFrame) -> DataFrame:
    """The two systems' tables under each other, by name, tagged."""
    return bank.withColumn("system", F.lit("Bank")).unionByName(telecom.withColumn("system", F.lit("Telecom")))


def first_faults(faults: DataFrame, n: int = 3) -> DataFrame:  # Q1
    order = Window.partitionBy("system").orderBy("timestamp", "component", "reason")
    return faults.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select("system", "level", "component", "reason", "onset")


def fault_types(faults: DataFrame) -> DataFrame:  # Q2
    n = faults.groupBy("system", "reason").agg(F.count("*").alias("faults"))
    share = F.col("faults") / F.sum("faults").over(Window.partitionBy("system"))
    return n.withColumn("share", percent(share, 0)).orderBy("system", F.desc("faults"), "reason")


def faults_per_day(faults: DataFrame) -> DataFrame:  # Q3
    n = faults.groupBy("system", "day").agg(F.count("*").alias("n"))
    return n.groupBy("system").agg(F.count("*").alias("days_with_faults"), F.min("n").alias("min_per_day"), F.max("n").alias("max_per_day"), F.sum("n").alias("total"))


def recorded_days(split: DataFrame) -> DataFrame:
    """Days named in a split table."""
    return split.select(F.explode(F.split("days", ", ")).alias("day")).select(F.to_date("day").alias("day")).distinct()


def faults_on_recorded_days(faults: DataFrame, days: DataFrame) -> DataFrame:  # Q4, days: system, day
    n = faults.groupBy("system", "day").agg(F.count("*").alias("faults"))
    return days.join(n, ["system", "day"], "left").select("system", "day", F.coalesce("faults", F.lit(0)).alias("faults"), F.date_format("day", "MM-dd").alias("label"))


def missingness_histogram(missing: DataFrame, width: float = 0.025) -> DataFrame:  # Q5, missing: system, feature, raw, after_cleaning
    long = missing.unpivot(["system", "feature"], ["raw", "after_cleaning"], "stage", "missing").where("missing is not null")
    stage = F.when(F.col("stage") == "raw", "Raw 1-minute grid").otherwise("After cleaning")
    return long.groupBy("system", stage.alias("stage"), F.floor(F.col("missing") / width + 1e-9).alias("bin")).agg(F.count("*").alias("n"))


def closeup_panels(closeups: DataFrame) -> DataFrame:  # Q6
    panel = F.concat("component", F.lit(", "), "reason", F.lit(" ("), F.col("onset").cast("string"), F.lit(")"))
    return closeups.withColumns({"panel": panel, "kpi": F.regexp_replace("kpi", r"^OSLinux-OSLinux_|^container\.", "")})


def profile_band(profiles: DataFrame) -> DataFrame:  # Q7, profiles: system, kind, minute, change
    kind = F.when(F.col("kind") == "fault", "Around a fault start").otherwise("Random fault-free time")
    out = profiles.groupBy("system", kind.alias("kind"), "minute").agg(F.avg("change").alias("mean"), (F.stddev_samp("change") / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})


def change_by_type(profiles: DataFrame, base_to: int = -30, onset_to: int = 5) -> DataFrame:  # Q8, profiles: system, kind, reason, onset, minute, change
    m = F.col("minute")
    period = F.when(m < base_to, "base").when(m < 0, "pre").when(m <= onset_to, "onset").otherwise("later")
    f = profiles.where("kind = 'fault'").withColumn("period", period)
    n = f.groupBy("system", "reason").agg(F.count_distinct("onset").alias("faults"))
    wide = f.groupBy("system", "reason").pivot("period", ["base", "pre", "onset", "later"]).agg(F.avg("change"))
    out = wide.join(n, ["system", "reason"]).select("system", "reason", "faults", signed(F.col("pre") - F.col("base")).alias("before_start"), signed(F.col("onset") - F.col("base")).alias("after_start"))
    return out.orderBy("system", F.desc("faults"), "reason")


def metrics_table(metrics: DataFrame, predictions: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:  # Q9
    """A row a horizon (of each of `keys`). The alarmed share comes from predictions, or, where these are gone, from the confusion counts, which give the same."""
    if predictions is None:
        alarmed = metrics.withColumn("alarmed", (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    else:
        alarmed = metrics.join(predictions.groupBy(*keys, "horizon").agg(F.avg(F.col("alarm").cast("double")).alias("alarmed")), [*keys, "horizon"], "left")
    return alarmed.select(
        *keys,
        "horizon",
        F.bround("base_rate", 3).alias("base_rate"),
        interval(F.col("pr_auc"), F.col("pr_auc_lo"), F.col("pr_auc_hi")).alias("pr_auc"),
        shown("%.2f", F.col("pr_lift")).alias("lift"),
        F.bround("roc_auc", 3).alias("roc_auc"),
        percent(F.col("alarmed")).alias("alarmed"),
        F.format_string("%d / %d", "events_detected", "n_events").alias("caught"),
        F.bround("false_alarms_per_day", 1).alias("false_alarms_per_day"),
    )


def history_long(history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:  # Q10
    long = history.unpivot([*keys, "horizon", "epoch", "best_epoch", "fold"], ["train_loss", "val_pr_auc"], "metric", "value")
    name = F.when(F.col("metric") == "train_loss", "Training loss").otherwise("Validation PR-AUC")
    best = (F.col("epoch") == F.col("best_epoch")) & (F.col("metric") == "val_pr_auc")
    return long.select(*keys, "horizon", F.concat(F.lit("H = "), F.col("horizon")).alias("h"), "epoch", name.alias("metric"), "value", best.alias("is_best")).orderBy("horizon", "metric", "epoch")


def timeline(predictions: DataFrame, metrics: DataFrame, faults: DataFrame, system: str, test_start: str, horizon: int = 5, offset: int = 28800) -> tuple[DataFrame, DataFrame]:  # Q11
    """Scores with local time, day and threshold; onsets from the first test day on."""
    at = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, timestamp + {offset})")
    threshold = metrics.where(F.col("horizon") == horizon).select("horizon", "threshold")
    scores = predictions.where(F.col("horizon") == horizon).join(F.broadcast(threshold), "horizon").withColumn("time", at).withColumn("day", F.date_format("time", "MM-dd"))
    onsets = faults.where((F.col("system") == system) & (F.col("day") >= F.lit(test_start).cast("date"))).withColumn("label", F.date_format("onset", "MM-dd"))
    return scores, onsets


def drift_table(drift: DataFrame, strip: str) -> tuple[DataFrame, DataFrame]:  # Q12
    """Drift with short feature names and day codes; the distinct day bands."""
    coded = drift.withColumns({"feature": F.regexp_replace("feature", strip, ": "), "label": F.date_format("day", "MM-dd")})
    codes = coded.select("label").distinct().withColumn("x", F.dense_rank().over(Window.orderBy("label")))  # a row a day
    out = coded.join(F.broadcast(codes), "label")
    return out, out.select("x", "label", "split").distinct()


def lift_by_run(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:  # Q13, runs: metrics with run, run_order
    return runs.select(*keys, "run", "run_order", "horizon", "pr_lift", (F.col("pr_auc_lo") / F.col("base_rate")).alias("lift_lo"), (F.col("pr_auc_hi") / F.col("base_rate")).alias("lift_hi")).orderBy("run_order", "horizon")


def split_table(splits: DataFrame, horizon: int = 5, year: str = "20(20|21)-") -> DataFrame:  # Q14
    s = splits.where(F.col("horizon") == horizon)
    return s.select("system", title_case("split").alias("split"), F.regexp_replace("days", year, "").alias("days"), "windows", "positive", percent(F.col("positive") / F.col("windows")).alias("share"), "shape")


def study_lifts(lookback: DataFrame, hidden: DataFrame) -> DataFrame:  # Q15
    named = lookback.withColumns({"setting": F.lit("Look-back L (minutes)"), "value": F.col("lookback")}).unionByName(hidden.withColumns({"setting": F.lit("Hidden units d"), "value": F.col("hidden")}))
    wide = named.select("system", "setting", "value", F.col("val_lift").alias("Validation"), F.col("test_lift").alias("Test"), (F.col("test_lo") / F.col("test_base")).alias("lo"), (F.col("test_hi") / F.col("test_base")).alias("hi"))
    long = wide.unpivot(["system", "setting", "value", "lo", "hi"], ["Validation", "Test"], "data", "lift")
    test_only = lambda c: F.when(F.col("data") == "Test", F.col(c))
    return long.withColumns({"lo": test_only("lo"), "hi": test_only("hi")})


def seed_stability(seeds: DataFrame) -> DataFrame:  # Q16
    spread = lambda c: F.concat(shown("%.2f", F.avg(c)), F.lit(" ("), shown("%.2f", F.stddev_samp(c)), F.lit(")"))
    reach = lambda c: F.concat(shown("%.2f", F.min(c)), F.lit(" to "), shown("%.2f", F.max(c)))
    return seeds.groupBy("system").agg(F.count("*").alias("runs"), spread("val_lift").alias("val_lift"), spread("test_lift").alias("test_lift"), reach("test_lift").alias("test_range"), reach("test_roc").alias("roc_range"))


def gates_by_minute(gates: DataFrame) -> DataFrame:  # Q17
    return gates.withColumn("gate", title_case("gate"))


def saliency_by_minute(saliency: DataFrame) -> DataFrame:  # Q18
    return saliency.select("system", "minute", "label", "saliency")


def top_features(saliency: DataFrame, n: int = 8) -> DataFrame:  # Q19
    order = Window.partitionBy("system").orderBy(F.desc("saliency"), "feature")
    ranked = saliency.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("system", "rank", series_component(F.col("feature")).alias("component"), F.regexp_replace(series_kpi(F.col("feature")), KPI_PREFIXES, "").alias("kpi"))


def compare_systems(metrics: DataFrame) -> DataFrame:  # Q20
    reach = lambda c: F.concat(shown("%.2f", F.min(c)), F.lit(" to "), shown("%.2f", F.max(c)))
    above = F.format_string("%d of %d", F.count_if(F.col("pr_auc_lo") > F.col("base_rate")), F.count("*"))
    return metrics.groupBy("system").agg(reach("pr_lift").alias("lift_range"), reach("roc_auc").alias("roc_range"), above.alias("above_base"), F.min_by("n_events", "horizon").alias("test_faults"))
