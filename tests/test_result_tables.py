"""Report queries on small result tables made by hand: their columns stand in another order, and some lack."""

import pytest

from minutewise.operators.lstm import n_parameters
from minutewise.plans import report
from minutewise.plans.schemas import HISTORY, METRICS, SALIENCY_FEATURE, SPLIT, STUDY
from minutewise.sources.files import read_csv_by_name, read_runs

#: Two horizons: 10 of 100 minutes and 20 of 80 are positive.
METRIC_ROWS = """pr_auc,horizon,base_rate,pr_auc_lo,pr_auc_hi,roc_auc,threshold,tp,fp,fn,tn,n_events,events_detected,false_alarms_per_day,pr_lift
0.2,5,0.1,0.15,0.3,0.6,0.5,4,6,6,84,3,2,1.25,2.0
0.3,10,0.25,0.2,0.4,0.55,0.5,10,10,10,50,4,1,2.5,1.2
"""


def table(spark, folder, name, text, schema):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return read_csv_by_name(spark, str(path), schema)


def test_metrics_by_name_and_their_table(spark, tmp_path):
    metrics = table(spark, tmp_path, "metrics.csv", METRIC_ROWS, METRICS)
    first = metrics.where("horizon = 5").first()
    assert (first["pr_auc"], first["tp"], first["seconds"], first["fold"]) == (0.2, 4, None, None)
    rows = {r["horizon"]: r for r in report.metrics_table(metrics).collect()}
    assert {h: (r["lift"], r["caught"], r["roc_auc"]) for h, r in rows.items()} == {5: ("2.00", "2 / 3", 0.6), 10: ("1.20", "1 / 4", 0.55)}
    assert rows[5]["alarmed"].startswith("10") and rows[10]["alarmed"].startswith("25")
    both = report.both(metrics, metrics.where("horizon = 10"))
    told = {r["system"]: r for r in report.compare_systems(both).collect()}
    assert told["Bank"]["lift_range"] == "1.20 to 2.00" and told["Bank"]["above_base"] == "1 of 2" and told["Bank"]["test_faults"] == 3
    assert told["Telecom"]["lift_range"] == "1.20 to 1.20" and told["Telecom"]["above_base"] == "0 of 1" and told["Telecom"]["test_faults"] == 4


def test_runs_stand_in_order(spark, tmp_path):
    for run in report.RUNS:
        folder = tmp_path / run
        folder.mkdir()
        (folder / "metrics.csv").write_text(METRIC_ROWS)
    rows = report.lift_by_run(read_runs(spark, str(tmp_path), report.RUNS, "metrics.csv", METRICS)).collect()
    assert len(rows) == 2 * len(report.RUNS) and [r["run_order"] for r in rows] == sorted(r["run_order"] for r in rows)
    assert all(r["lift_lo"] == pytest.approx(1.5) and r["lift_hi"] == pytest.approx(3.0) for r in rows if r["horizon"] == 5)


def test_history_marks_the_best_epoch_of_validation(spark, tmp_path):
    text = "epoch,horizon,train_loss,val_pr_auc,best_epoch,fold\n1,5,0.7,0.2,2,0\n2,5,0.6,0.4,2,0\n3,5,0.5,0.3,2,0\n"
    rows = report.history_long(table(spark, tmp_path, "history.csv", text, HISTORY)).collect()
    assert len(rows) == 6 and [(r["epoch"], r["metric"], r["value"]) for r in rows if r["is_best"]] == [(2, "Validation PR-AUC", 0.4)]


def test_splits_of_one_horizon(spark, tmp_path):
    text = 'horizon,fold,split,days,windows,positive,shape,clipped_share\n5,0,train,"2021-03-04, 2021-03-05",200,50,"(200, 60, 6)",0.01\n10,0,train,"2021-03-04",9,9,x,0\n'
    split = table(spark, tmp_path, "split.csv", text, SPLIT)
    rows = report.split_table(report.both(split, split)).collect()
    assert sorted(r["system"] for r in rows) == ["Bank", "Telecom"]
    assert {(r["split"], r["days"], r["windows"], r["positive"], r["shape"]) for r in rows} == {("Train", "03-04, 03-05", 200, 50, "(200, 60, 6)")}
    assert all(r["share"].startswith("25") for r in rows)


def test_sweeps_and_seeds(spark, tmp_path):
    text = "lookback,hidden,seed,test_lo,test_hi,test_base,test_roc,val_lift,test_lift\n30,64,1,0.1,0.4,0.2,0.5,1.0,1.5\n60,64,2,0.2,0.6,0.2,0.7,2.0,2.5\n"
    study = table(spark, tmp_path, "study.csv", text, STUDY)
    both = report.both(study, study)
    rows = report.study_lifts(both, both).where("system = 'Bank' and setting like 'Look%'").collect()
    assert {(r["value"], r["data"], r["lift"], r["lo"], r["hi"]) for r in rows if r["value"] == 30} == {(30, "Validation", 1.0, None, None), (30, "Test", 1.5, 0.5, 2.0)}
    seeds = {r["system"]: r for r in report.seed_stability(both).collect()}["Bank"]
    assert (seeds["runs"], seeds["val_lift"], seeds["test_lift"]) == (2, "1.50 (0.71)", "2.00 (0.71)")
    assert (seeds["test_range"], seeds["roc_range"]) == ("1.50 to 2.50", "0.50 to 0.70")


def test_most_telling_features_by_rank_then_name(spark, tmp_path):
    text = "feature,saliency\nb||mem,0.5\na||cpu,0.5\nc||net,0.9\n"
    salient = table(spark, tmp_path, "saliency.csv", text, SALIENCY_FEATURE)
    rows = report.top_features(report.both(salient, salient), 2).where("system = 'Bank'").orderBy("rank").collect()
    assert [r["component"] for r in rows] == ["c", "a"]


def test_parameters_of_a_cell_with_two_biases():
    # Four gates of d units over k inputs, d states and two biases; the output layer has d weights and a bias.
    assert all(n_parameters(k, d) == 4 * d * (k + d + 2) + d + 1 for k in (2, 128) for d in (8, 64))
