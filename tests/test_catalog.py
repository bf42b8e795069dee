"""Catalogue queries against their DuckDB twins on the smallest tables."""

import math
import os

import duckdb
import pytest

from minutewise.plans import models, report_queries, streams  # noqa: F401
from minutewise.plans.catalog import QUERIES, SQL

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
CHOSEN = [
    "fault_first3", "fault_share", "faults_per_day_zero_fill", "grid_reindex", "wide_unpivot", "observed_every_day", "gap_median", "bounded_ffill", "prep_summary", "robust_scale", "anova_within_day",
    "window_stats", "change_inputs", "label_mask", "folds_cv", "neg_subsample_count", "split_summary", "pr_auc", "roc_auc", "threshold_confusion", "event_detection", "pooled_metrics", "onset_profile",
    "quiet_times", "closeup", "drift", "string_funcs", "ts_funcs", "math_funcs", "dot_product", "union_by_name", "bootstrap_ci", "series_missingness", "prepared_fold", "q1_first_faults", "q2_fault_types",
    "q3_faults_per_day", "q4_faults_on_recorded_days", "q5_missingness_histogram", "q6_closeup_panels", "q7_profile_band", "q8_change_by_type", "q9_metrics_table", "q11_timeline", "q11_onsets", "q12_drift",
    "q12_bands", "q14_split_table", "q20_compare_systems", "run_events", "run_splits", "fold_scaling", "fold_prep", "fold_series", "fold_windows",
    "stream_features", "stream_episodes", "stream_day_sketch", "rolling_thresholds", "rolling_alarms",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6g}"
    return str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in out.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_every_query_has_a_name_and_all_but_the_trained_models_a_twin():
    without = set(QUERIES) - set(SQL)
    trained = ("lstm_", "logreg_", "model_", "q10_", "q15_", "q16_", "q17_", "q18_", "q19_", "window_arrays")
    assert set(SQL) < set(QUERIES) and all(name.startswith(trained) for name in without)


def test_model_tables_hang_together(spark):
    """The report's model tables (the smallest tables hold no series that is kept): shapes, and metrics that follow from the predictions."""
    history = QUERIES["q10_history"](spark, MORE).collect()
    assert {r["metric"] for r in history} == {"Training loss", "Validation PR-AUC"} and sum(r["is_best"] for r in history) == len({(r["system"], r["horizon"]) for r in history})
    settings = {(r["setting"], r["value"]) for r in QUERIES["q15_study_lifts"](spark, MORE).collect()}
    assert settings == {("Look-back L (minutes)", n) for n in models.LOOKBACKS} | {("Hidden units d", d) for d in models.HIDDEN}
    assert all(r["runs"] == 5 for r in QUERIES["q16_seed_stability"](spark, MORE).collect())
    gates = QUERIES["q17_gates"](spark, MORE).collect()
    assert {r["gate"] for r in gates} == {"Forget", "Input", "Output"} and all(0 < r["mean"] < 1 for r in gates)
    top = QUERIES["q19_top_features"](spark, MORE).collect()
    series = {(r["system"], r["component"], r["kpi"]) for r in models.fit(spark, MORE).where("kept").collect()}
    assert top and all((r["system"], r["component"], r["kpi"]) in series for r in top)
    told = {(r["system"], r["run"], r["horizon"]): r for r in QUERIES["model_metrics"](spark, MORE).collect()}
    assert {r[1] for r in told} == {"chrono-level", "chrono-change", "cv-level", "cv-change", "chrono-level-logreg", "cv-level-logreg"}
    counts = {}
    for r in QUERIES["model_predictions"](spark, MORE).collect():
        assert r["alarm"] == (r["score"] >= r["threshold"])
        key = r["system"], r["run"], r["horizon"]
        counts.setdefault(key, [0, 0, 0, 0])[2 * (1 - r["alarm"]) + (1 - r["y"])] += 1
    assert {k: [r["tp"], r["fp"], r["fn"], r["tn"]] for k, r in told.items()} == counts


def test_result_tables_are_written_and_read_back(spark, tmp_path):
    from minutewise.sources.files import read_csv_by_name

    names = models.write_results(spark, MORE, str(tmp_path), recurrent=False)
    assert len(names) == 6
    back = read_csv_by_name(spark, f"{tmp_path}/missingness", "component string, kpi string, raw double, after_cleaning double, absent int")
    want = {(r["component"], r["kpi"]): (r["raw"], r["after_cleaning"], None) for r in report_queries.missingness(spark, MORE).collect()}
    assert {(r["component"], r["kpi"]): tuple(r)[2:] for r in back.collect()} == want
    assert all(spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() for name in names)


def test_onsets_that_the_grid_lacks_are_an_error(spark):
    from minutewise.operators.evaluate import located

    grid = spark.createDataFrame([(1, 5, 53)], "day int, t int, row long")
    assert located(spark.createDataFrame([(1, 5, "a")], "day int, t int, r string"), grid, ["day", "t"]).first()["row"] == 53
    with pytest.raises(Exception, match="no grid row for the onset at 1 6"):
        located(spark.createDataFrame([(1, 6, "a")], "day int, t int, r string"), grid, ["day", "t"]).collect()
