"""Operators against small plain twins."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutewise.functions import scalars as S
from minutewise.operators import clean, evaluate, explore, features, grid, lstm
from minutewise.plans.schemas import BANK, SourceSpec
from minutewise.sources.files import read_csv, read_faults, read_metrics, write_matrix, write_result
from minutewise.streaming.minutes import stream_minute_means


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metric_files_to_grid(spark, tmp_path):
    for day in ("2021-03-04", "2021-03-05"):
        os.makedirs(tmp_path / day)
        (tmp_path / day / "metric_a.csv").write_text("timestamp,cmdb_id,kpi_name,value\n61,h1,cpu,1\n119,h1,cpu,3\n180,h1,cpu,NaN\n")
        (tmp_path / day / "wide_a.csv").write_text("timestamp,tc,rr,sr\n61000,s1,5,\n")
    os.makedirs(tmp_path / "notes")
    (tmp_path / "notes" / "metric_a.csv").write_text("timestamp,cmdb_id,kpi_name,value\n61,h9,cpu,1\n")
    long = read_metrics(spark, str(tmp_path), SourceSpec("long", "metric_*.csv", "timestamp", "cmdb_id", 1, "kpi_name", "value"))
    wide = read_metrics(spark, str(tmp_path), SourceSpec("wide", "wide_*.csv", "timestamp", "tc", 1000, value_cols=("rr", "sr")))
    both = long.unionByName(wide).withColumn("t", grid.bucket_of_second(F.col("second"), 1440))
    means = grid.grid_mean(both, ["day", "t", "component", "kpi"])
    got = {(r["day"], r["t"], r["component"], r["kpi"]): r["value"] for r in means.collect()}
    assert got["2021-03-04", 1, "h1", "cpu"] == 2.0 and got["2021-03-05", 1, "s1", "rr"] == 5.0
    assert got["2021-03-04", 3, "h1", "cpu"] is None and len(got) == 6
    full = grid.reindex(means, means, 4, ["component", "kpi"])
    assert full.count() == 2 * 4 * 2
    write_matrix(full.withColumn("system", F.lit("Bank")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("system = 'Bank'").count() == 16


def test_faults_and_result_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("level,component,timestamp,datetime,reason\npod,a,1614841020.0,2021-03-04 14:57:00,cpu\n")
    row = read_faults(spark, str(tmp_path / "f.csv"), BANK).first()
    assert row["day"] == dt.date(2021, 3, 4) and row["onset"] == dt.datetime(2021, 3, 4, 14, 57)
    write_result(frame(spark, [(1, None), (2, 0.5)], "a int, b double"), str(tmp_path / "r"))
    assert sorted((r["a"], r["b"]) for r in read_csv(spark, str(tmp_path / "r"), "a int, b double").collect()) == [(1, None), (2, 0.5)]


def test_bounded_ffill_like_pandas(spark):
    rng = np.random.default_rng(0)
    rows = [("c", k, d, t, None if rng.random() < 0.6 else float(rng.integers(9))) for k in "ab" for d in (1, 2) for t in range(40)]
    g = frame(spark, rows, "component string, kpi string, day int, t int, value double")
    limits = frame(spark, [("c", "a", 2), ("c", "b", 4)], "component string, kpi string, limit int")
    got = clean.bounded_ffill(g, limits).toPandas().sort_values(["kpi", "day", "t"])
    p = pd.DataFrame(rows, columns=["component", "kpi", "day", "t", "value"]).sort_values(["kpi", "day", "t"])
    want = p.groupby(["kpi", "day"])["value"].transform(lambda v: v.ffill(limit=2 if p.kpi[v.index[0]] == "a" else 4))
    assert got.filled.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_ranking_metrics_like_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.random() < 0.3), float(rng.integers(40)) / 8) for k in "ab" for _ in range(3000)]
    df = frame(spark, rows, "k string, y int, score double")
    p = pd.DataFrame(rows, columns=["k", "y", "score"])
    ap = {r["k"]: r["pr_auc"] for r in evaluate.pr_auc(df, ["k"]).collect()}
    roc = {r["k"]: r["roc_auc"] for r in evaluate.roc_auc(df, ["k"]).collect()}
    for k, g in p.groupby("k"):
        assert abs(ap[k] - lstm.pr_area(g.y.to_numpy(), g.score.to_numpy())) < 1e-12
        ranks, n = g.score.rank(), g.y.sum()
        assert abs(roc[k] - (ranks[g.y == 1].sum() - n * (n + 1) / 2) / (n * (len(g) - n))) < 1e-12
    assert evaluate.pr_auc(df.where("y = 0"), ["k"]).first()["pr_auc"] is None
    inverse = {r["k"]: r["roc_auc"] for r in evaluate.roc_auc(df.withColumn("score", -F.col("score")), ["k"]).collect()}
    assert all(abs(roc[k] + inverse[k] - 1) < 1e-12 for k in roc)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=1, max_size=40), st.randoms())
def test_average_precision_ignores_row_order(rows, random):
    y, s = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    order = list(range(len(rows)))
    random.shuffle(order)
    a, b = lstm.pr_area(y, s), lstm.pr_area(y[order], np.exp(s[order]))
    assert (np.isnan(a) and np.isnan(b)) or abs(a - b) < 1e-12


def test_events_and_false_alarms(spark):
    alarms = {3, 4, 8, 9, 10, 20}
    y = {9: 1, 10: 1, 11: 1}
    rows = [(t, y.get(t, 0), t in alarms) for t in range(25) if t != 15]
    s = frame(spark, rows, "row long, y int, alarm boolean")
    on = frame(spark, [(1, 12), (2, 19)], "id int, row long")
    got = {r["id"]: (r["lead"], r["detected"]) for r in evaluate.event_detection(on, s, [], 3).collect()}
    assert got == {1: (3, True), 2: (None, False)}
    starts = evaluate.false_alarm_episodes(s.withColumn("d", F.lit(1)), ["d"]).select("row").collect()
    assert sorted(r["row"] for r in starts) == [3, 8, 20]


def test_anova_like_two_pass(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(y), float(1e6 + rng.normal() + y * (k == "a"))) for k in "ab" for y in rng.integers(0, 2, 200)]
    f = {r["s"]: r["f"] for r in features.anova_f(frame(spark, rows, "s string, y int, value double"), ["s"]).collect()}
    for k in "ab":
        x, y = np.array([r[2] for r in rows if r[0] == k]), np.array([r[1] for r in rows if r[0] == k])
        m = x.mean()
        between = sum((x[y == c].mean() - m) ** 2 * (y == c).sum() for c in (0, 1))
        within = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in (0, 1))
        assert abs(f[k] / (between / (within / (len(x) - 2))) - 1) < 1e-6


def test_windows_scaling_and_quiet_times(spark):
    v = frame(spark, [(1, t, float(t * t)) for t in range(6)], "day int, t int, v double")
    w = features.window_stats(features.look_back(v, 3, ["day"], "v")).orderBy("t").collect()
    assert len(w) == 4 and w[0]["window"] == [0.0, 1.0, 4.0] and w[0]["delta"] == 4.0 and abs(w[0]["std"] - np.std([0, 1, 4])) < 1e-9
    assert features.look_back(v, 3, ["day"], "v", pad=True).orderBy("t").first()["window"] == [0.0, 0.0, 0.0]
    assert features.change_inputs(features.look_back(v, 3, ["day"], "v")).orderBy("t").first()["window"] == [-1.0, 0.0, 3.0]
    cells = frame(spark, [(r,) for r in range(-30, 30)], "row long")
    on = frame(spark, [(0,), (-22,)], "row long")
    got = sorted(r["row"] for r in explore.quiet_times(cells, on, 5).collect())
    assert got == [r for r in range(-30, 30) if min(abs(r), abs(r + 22)) > 5]


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, int(rng.random() < 0.4), float(rng.random())) for i in range(400)]
    df = frame(spark, rows, "k string, i long, y int, score double")
    r = evaluate.block_bootstrap(df, ["k"], 400, reps=40, block=20).first()
    assert r["pr_auc_lo"] < evaluate.pr_auc(df, ["k"]).first()["pr_auc"] < r["pr_auc_hi"]


def test_bootstrap_draws_all_rows_of_uneven_groups(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 7, "b": 90, "c": 400}
    rows = [(k, 3 * i + 1, int(rng.random() < 0.4), int(rng.integers(0, 30))) for k, n in sizes.items() for i in range(n)]
    df = frame(spark, rows, "k string, id long, y int, score int")
    numbered, counts = evaluate.row_numbers(df, ["k"], "id")
    assert all(r["id"] == 3 * r["i"] + 1 for r in numbered.collect()) and {r["k"]: r["n_rows"] for r in counts.collect()} == sizes
    drawn = {}
    for k, n in sizes.items():
        drawn[k] = {rep: [i for a in starts for i in range(a, min(a + 20, n))] for rep, starts in enumerate(evaluate.block_starts(n, 40, 20).tolist())}
    assert {k: sorted({i for d in reps.values() for i in d}) for k, reps in drawn.items()} == {k: list(range(n)) for k, n in sizes.items()}
    got = {r["k"]: (r["pr_auc_lo"], r["pr_auc_hi"]) for r in evaluate.block_bootstrap(numbered, ["k"], counts, reps=40, block=20).collect()}
    for k, reps in drawn.items():
        of = [(y, s) for key, _, y, s in rows if key == k]
        aps = []
        for d in reps.values():
            ys = [of[i] for i in d]
            p = sum(y for y, _ in ys)
            if p:
                steps = [(sum(y for y, s in ys if s == t), [y for y, s in ys if s >= t]) for t in {s for _, s in ys}]
                aps.append(sum(n / p * sum(above) / len(above) for n, above in steps))
        assert np.allclose(got[k], np.percentile(aps, [2.5, 97.5]))


def test_hand_worked_cell_and_gradients():
    net = lstm.Lstm(1, 1, 0)
    net.p = {"wx": np.array([[0.8, 0.6, 0.9, 0.4]]), "wh": np.array([[0.1, -0.2, 0.3, 0.2]]), "bx": np.array([0.3, 0.5, 0.4, 0.6]), "bh": np.zeros(4), "v": np.ones(1), "c": np.zeros(1)}
    net.p["bx"] = np.array([0.3, 0.5, 0.4, 0.6])
    _, steps = net.forward(np.array([[[1.5], [0.3]]]))
    assert len(steps) == 2
    rng = np.random.default_rng(0)
    net, x = lstm.Lstm(3, 4, 1), rng.normal(size=(5, 6, 3))
    z, steps = net.forward(x)
    grad, dx = net.backward(x, steps, np.ones(5))
    for name in net.p:
        w = net.p[name]
        at = tuple(0 for _ in w.shape)
        old, eps = w[at], 1e-6
        w[at] = old + eps
        up = net.forward(x)[0].sum()
        w[at] = old - eps
        down = net.forward(x)[0].sum()
        w[at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-5
    y = x.copy()
    y[2, 3, 1] += 1e-6
    assert abs((net.forward(y)[0].sum() - z.sum()) / 1e-6 - dx[2, 3, 1]) < 1e-4


def test_scalar_expressions(spark):
    df = frame(spark, [("a||b", 0.125, -3)], "s string, x double, n int")
    r = df.select(
        S.series_component(F.col("s")).alias("c"), S.series_kpi(F.col("s")).alias("k"), S.percent(F.col("x")).alias("p"), S.signed(F.col("x")).alias("g"), S.floor_div(F.col("n"), 2).alias("f"),
        S.number_or_zero(F.lit(float("inf"))).alias("z"), S.array_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(None).cast("double"))).alias("m"),
    ).first()
    assert (r["c"], r["k"], r["p"], r["g"], r["f"], r["z"], r["m"]) == ("a", "b", "12.5%", "+0.125", -2, 0.0, 2.0)


def test_stream_minute_means(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m, s), "c", "k", float(s)) for m in (0, 1, 30) for s in (10, 20)]
    frame(spark, rows, "ts timestamp, component string, kpi string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, component string, kpi string, value double").parquet(str(tmp_path / "in"))
    q = stream_minute_means(stream).writeStream.outputMode("complete").format("memory").queryName("minutes").start()
    q.processAllAvailable()
    q.stop()
    assert {r["value"] for r in spark.table("minutes").collect()} == {15.0} and spark.table("minutes").count() == 3


def test_exact_quantiles_over_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [(k, None if rng.random() < 0.1 else float(rng.integers(0, 40) if k == "a" else rng.normal())) for k in "abc" for _ in range(500 if k != "c" else 1)]
    rows[-1] = ("c", 2.5)
    shares = {"low": 0.025, "mid": 0.5, "high": 0.9, "top": 1.0}
    got = {r["k"]: r for r in evaluate.quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", shares).collect()}
    for k in "abc":
        v = [x for key, x in rows if key == k and x is not None]
        assert np.allclose([got[k][s] for s in shares], np.quantile(v, list(shares.values())))


def test_closeup_by_the_halves_before_the_fault(spark):
    rng = np.random.default_rng(8)
    minutes = range(-7, 5)
    table = {s: {m: float(rng.normal() + 3 * (s == "b" and m >= -4)) for m in minutes} for s in "abcdef"}
    table["f"] = dict.fromkeys(minutes, 1.0)
    got = explore.closeup(frame(spark, [(s, m, v) for s, vs in table.items() for m, v in vs.items()], "s string, minute int, value double"), ["s"], 3).collect()
    contrast = {}
    for s, vs in table.items():
        late, early = [v for m, v in vs.items() if -4 <= m < 0], [v for m, v in vs.items() if m < -4]
        spread = max(vs.values()) - min(vs.values())
        contrast[s] = abs(np.mean(late) - np.mean(early)) / spread if spread else 0
    best = sorted(contrast, key=lambda s: (-contrast[s], s))[:3]
    assert {r["s"] for r in got} == set(best) and "b" in best
    assert all(abs(r["scaled"] - (table[r["s"]][r["minute"]] - min(table[r["s"]].values())) / (max(table[r["s"]].values()) - min(table[r["s"]].values()))) < 1e-12 for r in got)


def test_run_metrics_by_hand(spark):
    rng = np.random.default_rng(9)
    rows, onsets = [], [("r", 2, f, e, 48 * (3 * f + e) + 20) for f in (0, 1) for e in range(3)]
    for f in (0, 1):
        for d in range(3):
            for t in range(5, 40):
                row = 48 * (3 * f + d) + t
                rows.append(("r", 2, f, 3 * f + d, row, int(t in (18, 19)), float(np.round(rng.random(), 2)), bool(rng.random() < 0.3)))
    p = frame(spark, rows, "run string, horizon int, fold int, day int, row long, y int, score double, alarm boolean")
    days = frame(spark, [("r", f, 3 * f + d) for f in (0, 1) for d in range(3)], "run string, fold int, day int")
    m = evaluate.metrics(p, frame(spark, onsets, "run string, horizon int, fold int, event int, row long"), days, ["run"], reps=20, block=10).first()
    y, s, a = (np.array([r[i] for r in rows]) for i in (5, 6, 7))
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (int((a & (y == 1)).sum()), int((a & (y == 0)).sum()), int((~a & (y == 1)).sum()), int((~a & (y == 0)).sum()))
    steps = [(y[s == v].sum(), y[s >= v]) for v in np.unique(s)]
    assert abs(m["pr_auc"] - sum(n / y.sum() * above.mean() for n, above in steps)) < 1e-12 and abs(m["base_rate"] - y.mean()) < 1e-12
    assert abs(m["roc_auc"] - np.mean([(x > z) + 0.5 * (x == z) for x in s[y == 1] for z in s[y == 0]])) < 1e-12
    alarmed = {r[4] for r in rows if r[7]}
    leads = [next((k for k in (2, 1) if row - k in alarmed), None) for *_, row in onsets]
    assert (m["n_events"], m["events_detected"]) == (6, sum(x is not None for x in leads)) and m["median_lead_min"] == np.median([x for x in leads if x])
    false = [bool(r[7] and not r[5]) for r in rows]
    starts = sum(f and not (false[i - 1] and rows[i][4] - rows[i - 1][4] == 1) if i else f for i, f in enumerate(false))
    assert abs(m["false_alarms_per_day"] - starts / 6) < 1e-12 and m["test_days"] == 6 and m["pr_auc_lo"] < m["pr_auc_hi"]


def test_anova_of_small_and_constant_series(spark):
    rows = [("tiny", y, 1e-9 * (y + k / 10)) for y in (0, 1) for k in range(10)] + [("flat", y, 0.1) for y in (0, 1) for _ in range(10)] + [("split", y, 5.0 + y) for y in (0, 1) for _ in range(10)]
    f = {r["s"]: r["f"] for r in features.anova_f(frame(spark, rows, "s string, y int, value double"), ["s"]).collect()}
    assert f["tiny"] > 10 and f["flat"] == 0 and f["split"] == 0
    assert [r["s"] for r in features.top_k(features.anova_f(frame(spark, rows, "s string, y int, value double"), ["s"]), 2, ["s"], among=frame(spark, [("flat",)], "s string")).collect()] == ["flat"]


def test_pr_area_with_ties():
    rng = np.random.default_rng(4)
    for _ in range(20):
        y, s = rng.integers(0, 2, 40), rng.integers(0, 8, 40) / 8
        want = sum(y[s == v].sum() / y.sum() * y[s >= v].mean() for v in np.unique(s))
        assert abs(lstm.pr_area(y.astype(float), s) - want) < 1e-12
    assert np.isnan(lstm.pr_area(np.zeros(3), np.ones(3))) and np.isnan(lstm.pr_area(np.zeros(0), np.zeros(0)))


def test_models_are_rows_and_score_in_any_partition(spark):
    rng = np.random.default_rng(6)
    rows = []
    for fold in ("a", "b"):
        for split, n in (("train", 160), ("val", 60), ("test", 60)):
            for t in range(n):
                y = int(rng.random() < 0.3)
                rows.append((fold, split, 1, t, y, [[float(rng.normal() + 2 * y), float(rng.normal())] for _ in range(4)]))
    df = frame(spark, rows, "fold string, split string, day int, t int, y int, window array<array<double>>").repartition(3)
    models = lstm.fit_models(df, ["fold"], hidden=8, epochs=6).persist()
    told = {r["fold"]: r for r in models.collect()}
    assert set(told) == {"a", "b"} and all(r["params"] == lstm.n_parameters(2, 8) and len(r["epoch"]) <= 6 for r in told.values())
    scores = lstm.lstm_scores(df, models, ["fold"]).collect()
    assert len(scores) == 240
    for fold, r in told.items():
        net = lstm.restored(r["d"], np.array(r["weights"]))
        x = {(s, t): w for f, s, _, t, _, w in rows if f == fold}
        assert all(abs(float(net.scores(np.array([x[s["split"], s["t"]]]))[0]) - s["score"]) < 1e-5 for s in scores if s["fold"] == fold)
    study = {r["fold"]: r for r in lstm.sweep(lstm.lstm_scores(df, models, ["fold"]), models, ["fold"]).collect()}
    for f, r in study.items():
        y, v = (np.array([s[c] for s in scores if s["fold"] == f and s["split"] == "test"]) for c in ("y", "score"))
        assert abs(r["test_pr_auc"] - lstm.pr_area(y, v)) < 1e-9 and abs(r["test_lift"] - lstm.pr_area(y, v) / y.mean()) < 1e-9
    gates = lstm.lstm_gates(df, models, ["fold"]).where("fold = 'a'").collect()
    assert len(gates) == 4 * 3 * 2 and {r["label"] for r in gates} == {"other", "pre-fault"}
    salient = lstm.lstm_saliency(df, models, ["fold"])
    assert lstm.saliency_time(salient, ["fold"]).count() == 16 and sorted(r["fold"] for r in lstm.saliency_feature(salient, ["fold"], 1).collect()) == ["a", "b"]
    assert lstm.history(models, ["fold"]).where("fold = 'b'").count() == len(told["b"]["epoch"])


@pytest.mark.parametrize("few", [evaluate.FEW_KEYS, 0])
def test_quantiles_are_exact_whether_broadcast_or_not(spark, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW_KEYS", few)
    rng = np.random.default_rng(5)
    values = {
        "skewed": np.exp(rng.normal(0, 4, 5_000)),
        "far": 1e9 + rng.normal(0, 1e-3, 500),
        "ties": rng.integers(0, 3, 2_000).astype(float),
        "half": np.r_[np.zeros(600), rng.normal(size=601)],
        "one": np.array([7.0]),
        "two": np.array([-1.0, 4.0]),
    }
    rows = [(k, float(x)) for k, xs in values.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "p999": 0.999, "high": 1.0}
    got = {r["k"]: [r[n] for n in shares] for r in evaluate.quantiles(df, ["k"], "x", shares).collect()}
    assert got.keys() == values.keys()
    for k, xs in values.items():
        assert got[k] == pytest.approx(np.quantile(xs, list(shares.values())).tolist(), rel=1e-15, abs=1e-15), k
    whole = np.concatenate(list(values.values()))
    r = evaluate.quantiles(df, [], "x", shares).first()
    assert [r[n] for n in shares] == pytest.approx(np.quantile(whole, list(shares.values())).tolist(), rel=1e-15)
    assert evaluate.quantiles(df.where("false"), ["k"], "x", shares).count() == 0
