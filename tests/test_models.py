"""Fold tensors, all-at-once logistic regression, both trainers and the bootstrap against plain NumPy."""

import datetime

import numpy as np
import pytest

from minutewise.operators import evaluate, logistic, lstm, tensors

M, HORIZONS, L = 20, [1, 3], 4


def plain_fold(rng):
    """Values by day, series and bucket with gaps; onsets by day."""
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(8)]
    names = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "gone")]
    x = rng.normal(size=(8, 4, M)) * [[[1], [50], [3], [1]]] + 1e6 * np.array([0, 1, 0, 0])[None, :, None]
    x[rng.random(x.shape) < 0.4] = np.nan
    x[3, 3] = np.nan  # not seen on a training day
    y = (rng.random((8, 2, M)) < 0.2).astype(int)
    y[rng.random(y.shape) < 0.15] = -1
    return days, names, x, y


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    days, names, x, y = plain_fold(rng)
    means = [("Bank", c, k, days[d], t, float(x[d, s, t])) for d in range(8) for s, (c, k) in enumerate(names) for t in range(M) if not np.isnan(x[d, s, t])]
    means = spark.createDataFrame(means, "system string, component string, kpi string, day date, t int, value double")
    usable = spark.createDataFrame([("Bank", days[d], t, HORIZONS[h], int(y[d, h, t])) for d in range(8) for h in range(2) for t in range(M) if y[d, h, t] >= 0], "system string, day date, t int, horizon int, y int")
    folds = spark.createDataFrame([(f, s, days[d]) for f, of in (("f1", "ttttvxxx"), ("f2", "xxtttttv")) for d, s in enumerate(of.replace("t", "T"))], "fold string, split string, day date")
    from pyspark.sql import functions as F

    folds = folds.replace({"T": "train", "v": "val", "x": "test"}, subset=["split"])
    arrays = tensors.day_arrays(means, means.select("system").distinct().crossJoin(folds.select("day").distinct()), M, ["system"])
    plan = tensors.day_plan(folds, usable, HORIZONS, M)
    fit = tensors.fold_fit(arrays, plan, HORIZONS).persist()
    top = tensors.top_series(fit, HORIZONS, 2)
    blocks = tensors.fold_data(arrays, top, tensors.samples(usable, folds, 5, per_positive=2, least=6)).persist()
    assert F is not None
    return {"days": days, "names": names, "x": x, "y": y, "fit": fit, "top": top, "blocks": blocks}


SPLIT = {"f1": "ttttvxxx", "f2": "xxtttttv"}


def plain_clean(x, train):
    """Kept, limit, fill and the cleaned values of one series, days x buckets."""
    seen = ~np.isnan(x)
    kept = all(seen[d].any() for d in train) and 1 - seen[train].mean() <= 0.8
    gaps = [b - a for d in train for a, b in zip(np.flatnonzero(seen[d]), np.flatnonzero(seen[d])[1:], strict=False)]
    limit = max(2, 2 * int(np.median(gaps)) if gaps else 2)
    filled = np.full_like(x, np.nan)
    for d in range(len(x)):
        for t in range(M):
            back = [u for u in range(max(0, t - limit), t + 1) if seen[d, u]]
            filled[d, t] = x[d, back[-1]] if back else np.nan
    fill = np.nanmedian(filled[train]) if (~np.isnan(filled[train])).any() else 0.0
    return kept, limit, fill, np.where(np.isnan(filled), fill, filled)


def plain_f(v, y):
    a, b = v[y == 1], v[y == 0]
    between = len(a) * (a.mean() - v.mean()) ** 2 + len(b) * (b.mean() - v.mean()) ** 2
    return between / ((((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(v) - 2))


def plain(made):
    """fold, series: kept, limit, fill, scaled values, F by inputs and horizon."""
    out = {}
    for fold, of in SPLIT.items():
        train = [d for d in range(8) if of[d] == "t"]
        for s, name in enumerate(made["names"]):
            kept, limit, fill, clean = plain_clean(made["x"][:, s], train)
            q1, median, q3 = np.percentile(clean[train], [25, 50, 75])
            f = {}
            for h, horizon in enumerate(HORIZONS):
                rows = [(d, t) for d in train for t in range(M) if made["y"][d, h, t] >= 0]
                v, y = np.array([clean[r] for r in rows]), np.array([made["y"][d, h, t] for d, t in rows])
                own = np.array([np.mean([clean[e, u] for e, u in rows if e == d]) for d, _ in rows])
                f["level", horizon], f["change", horizon] = plain_f(v, y), plain_f(v - own, y)
            out[fold, name] = kept, limit, fill, np.clip((clean - median) / (q3 - q1), -10, 10), f
    return out


def test_fold_fit(made):
    want = plain(made)
    got = {(r["fold"], (r["component"], r["kpi"])): r for r in made["fit"].collect()}
    assert set(got) == set(want)
    for key, (kept, limit, fill, _, f) in want.items():
        r = got[key]
        assert (r["kept"], r["fill_limit"]) == (kept, limit) and abs(r["fill"] - fill) < 1e-9
        for h, horizon in enumerate(HORIZONS):
            assert np.isclose(r["f_level"][h], f["level", horizon], rtol=1e-6) and np.isclose(r["f_change"][h], f["change", horizon], rtol=1e-6)


def test_blocks_and_windows(made):
    want = plain(made)
    rows = made["blocks"].collect()
    assert len({tuple(r[c] for c in [*tensors.MODEL, "day"]) for r in rows}) == len(rows) > 0
    for r in rows:
        d, h = made["days"].index(r["day"]), HORIZONS.index(r["horizon"])
        assert r["split"] == {"t": "train", "v": "val", "x": "test"}[SPLIT[r["fold"]][d]]
        ranked = sorted((-v[4][r["inputs"], r["horizon"]], s) for (fold, s), v in want.items() if fold == r["fold"] and v[0])[:2]
        assert r["series"] == ["||".join(s) for _, s in ranked]
        assert all(made["y"][d, h, t] == y for t, y in zip(r["ts"], r["ys"], strict=True)) and r["ts"] == sorted(set(r["ts"]))
        if r["split"] != "train":
            assert r["ts"] == [t for t in range(M) if made["y"][d, h, t] >= 0]
        w = tensors.block_windows(r["x"], r["ts"], 2, L, r["inputs"] == "change")
        for t, one in zip(r["ts"], w, strict=True):
            z = np.stack([[want[r["fold"], s][3][d, max(0, u)] for _, s in ranked] for u in range(t - L + 1, t + 1)])
            assert np.allclose(one, np.clip(z - np.median(z, 0), -10, 10) if r["inputs"] == "change" else z)
    listed = tensors.window_rows(made["blocks"], L).where("inputs = 'level' and t >= 3")
    assert listed.count() == sum(len([t for t in r["ts"] if t >= 3]) * L * 2 for r in rows if r["inputs"] == "level")
    told = {tuple(r[c] for c in [*tensors.MODEL, "split"]): r for r in tensors.split_table(made["blocks"], L).collect()}
    for key, r in told.items():
        own = [b for b in rows if tuple(b[c] for c in [*tensors.MODEL, "split"]) == key]
        n = sum(len(b["ts"]) for b in own)
        assert (r["windows"], r["positive"], r["shape"]) == (n, sum(sum(b["ys"]) for b in own), f"{n} x {L} x 2")
        assert np.isclose(r["clipped_share"], np.mean(np.concatenate([np.abs(tensors.block_windows(b["x"], b["ts"], 2, L)).ravel() >= 10 for b in own])))


def gathered(blocks, key, split):
    own = sorted((b for b in blocks if tuple(b[c] for c in tensors.MODEL) == key and b["split"] == split), key=lambda b: b["day"])
    if not own:
        return np.zeros((0, L, 2)), np.zeros(0)
    return np.concatenate([tensors.block_windows(b["x"], b["ts"], 2, L, b["inputs"] == "change") for b in own]), np.concatenate([b["ys"] for b in own]).astype(float)


def newton(x, y, c):
    """The optimum by undamped steps from zero, in plain NumPy, checked by its gradient."""
    z = np.c_[x, np.ones(len(x))]
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    free, w = np.r_[np.ones(x.shape[1]), 0], np.zeros(x.shape[1] + 1)
    for _ in range(100):
        h = 1 / (1 + np.exp(-z @ w))
        g = free * w + c * z.T @ (s * (h - y))
        w = w - np.linalg.solve(np.diag(free) + c * (z.T * (s * h * (1 - h))) @ z, g)
    assert np.abs(g).max() < 1e-8
    return w


def test_logistic_regression_is_the_optimum(made):
    blocks = made["blocks"].collect()
    rows = logistic.summaries(made["blocks"], L).persist()
    grid = [0.01, 1.0]
    models = logistic.fit_logistic(rows.where("split = 'train'"), grid).collect()
    keys = {tuple(b[c] for c in tensors.MODEL) for b in blocks}
    assert {tuple(m[c] for c in tensors.MODEL) for m in models} == keys
    scores, told = logistic.logistic_scores(made["blocks"], L, grid)
    scores = {(tuple(r[c] for c in tensors.MODEL), r["day"], r["t"]): r["score"] for r in scores.collect()}
    chosen = {tuple(r[c] for c in tensors.MODEL): r for r in told.collect()}
    for m in models:
        key = tuple(m[c] for c in tensors.MODEL)
        (x, y), (v, yv) = gathered(blocks, key, "train"), gathered(blocks, key, "val")
        stats = lambda w: np.concatenate([np.stack([w[:, -1, j], w[:, :, j].mean(1), w[:, :, j].std(1), w[:, :, j].min(1), w[:, :, j].max(1), w[:, -1, j] - w[:, 0, j]], 1) for j in range(2)], 1)
        mu, sd = stats(x).mean(0), stats(x).std(0)
        sd = np.where(sd > 1e-9, sd, 1)
        ws = [newton((stats(x) - mu) / sd, y, c) for c in grid]
        assert np.allclose(np.reshape(m["w"], (2, -1)), ws, atol=1e-6)
        score = lambda w, of: 1 / (1 + np.exp(-np.c_[(stats(of) - mu) / sd, np.ones(len(of))] @ w))  # noqa: E731, B023
        aps = [np.nan_to_num(lstm.pr_area(yv, score(w, v))) for w in ws]
        best = int(np.argmax(aps))
        assert chosen[key]["c"] == grid[best] and abs(chosen[key]["val_pr_auc"] - aps[best]) < 1e-9 and chosen[key]["n_inputs"] == 12
        for b in blocks:
            if tuple(b[c] for c in tensors.MODEL) == key and b["split"] == "test":
                own = score(ws[best], tensors.block_windows(b["x"], b["ts"], 2, L, b["inputs"] == "change"))
                assert np.allclose([scores[key, b["day"], t] for t in b["ts"]], own, atol=1e-6)


def test_one_class_has_no_logistic_model(made, spark):
    one = made["blocks"].where("horizon = 1 and fold = 'f1' and inputs = 'level'").select(*tensors.MODEL, "split", "day", "series", "ts", "x")
    from pyspark.sql import functions as F

    rows = logistic.summaries(one.withColumn("ys", F.transform("ts", lambda t: F.lit(0))), L)
    assert logistic.fit_logistic(rows.where("split = 'train'")).count() == 0


def test_trainers_and_what_they_tell(made):
    level = made["blocks"].where("inputs = 'level' and fold = 'f1'")
    blocks = level.collect()
    models = lstm.fit_models(level, tensors.MODEL, hidden=5, epochs=3, lookback=L).persist()
    key = ("Bank", "level", "f1", 3)
    (x, y), (v, yv), (t, yt) = (gathered(blocks, key, s) for s in ("train", "val", "test"))
    net, history = lstm.train(x, y, v, yv, 5, 20260916, 3)
    row = models.where("horizon = 3").first()
    assert np.allclose(row["weights"], lstm.flat(net.p)) and row["epoch"] == [h["epoch"] for h in history] and row["params"] == lstm.n_parameters(2, 5)
    got = lstm.lstm_scores(level, models, tensors.MODEL, L).where("horizon = 3 and split = 'test'").orderBy("day", "t").collect()
    assert np.allclose([r["score"] for r in got], net.scores(t), atol=1e-6) and [r["y"] for r in got] == yt.tolist()
    # Gates and saliency from their definitions.
    _, steps = net.forward(t)
    gates = {(r["minute"], r["gate"], r["label"]): r["mean"] for r in lstm.lstm_gates(level, models, tensors.MODEL, L).where("horizon = 3").collect()}
    for i, (_, a, f, _, o, _) in enumerate(steps):
        for name, g in (("input", a), ("forget", f), ("output", o)):
            for c, label in enumerate(lstm.LABELS):
                assert np.isclose(gates[i - L + 1, name, label], g[yt == c].mean())
    base, eps, dx = t.copy(), 1e-5, np.zeros_like(t)
    for i in range(L):
        for j in range(2):
            up, down = base.copy(), base.copy()
            up[:, i, j] += eps
            down[:, i, j] -= eps
            dx[:, i, j] = (net.forward(up)[0] - net.forward(down)[0]) / (2 * eps)
    s = np.abs(dx * t)
    salient = lstm.lstm_saliency(level, models, tensors.MODEL, L)
    by_minute = {(r["minute"], r["label"]): r["saliency"] for r in lstm.saliency_time(salient, tensors.MODEL).where("horizon = 3").collect()}
    assert all(np.isclose(by_minute[i - L + 1, lstm.LABELS[c]], s[yt == c].mean(axis=(0, 2))[i], rtol=1e-4) for i in range(L) for c in (0, 1))
    series = next(b["series"] for b in blocks if b["horizon"] == 3)
    by_series = {r["feature"]: r["saliency"] for r in lstm.saliency_feature(salient, tensors.MODEL).where("horizon = 3").collect()}
    assert all(np.isclose(by_series[name], s.mean(axis=(0, 1))[j], rtol=1e-4) for j, name in enumerate(series))


def test_models_joined_by_key_score_alike(made, monkeypatch):
    level = made["blocks"].where("inputs = 'level' and fold = 'f1'")
    models = lstm.fit_models(level, tensors.MODEL, hidden=3, epochs=1, lookback=L).persist()
    once = {tuple(r) for r in lstm.lstm_scores(level, models, tensors.MODEL, L).collect()}
    monkeypatch.setattr(lstm, "BROADCAST_NUMBERS", 0)
    assert {tuple(r) for r in lstm.lstm_scores(level, models, tensors.MODEL, L).collect()} == once


def test_synchronous_training_is_full_batch_training(made):
    level = made["blocks"].where("inputs = 'level' and fold = 'f1'").repartition(5)
    blocks = level.collect()
    got = {r["horizon"]: r for r in lstm.fit_full_batch(level, tensors.MODEL, L, hidden=4, seed=3, epochs=3).collect()}
    for horizon in HORIZONS:
        own = sorted((b for b in blocks if b["horizon"] == horizon and b["split"] == "train"), key=lambda b: b["day"])
        v, yv = gathered(blocks, ("Bank", "level", "f1", horizon), "val")
        x, y = gathered(blocks, ("Bank", "level", "f1", horizon), "train")
        net = lstm.Lstm(2, 4, 3)
        m, s = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
        losses, aps, weights = [], [], []
        for epoch in range(1, 4):
            keep = np.concatenate([lstm.dropout(len(b["ts"]), 4, 3, epoch, b["day"], b["ts"]) for b in own])
            out = lstm.block_gradient(net, x, y, (len(y) - y.sum()) / y.sum(), keep) / len(y)
            losses.append(out[0])
            blank = lstm.restored(4, out[1:]).p
            lstm.adam(net.p, m, s, blank, epoch)
            aps.append(np.nan_to_num(lstm.pr_area(yv, net.scores(v))))
            weights.append(lstm.flat(net.p))
        r = got[horizon]
        best = int(np.argmax(aps))
        assert r["best_epoch"] == best + 1 and np.allclose(r["train_loss"], losses) and np.allclose(r["weights"], weights[best])


@pytest.mark.parametrize("part", [4096, 30])
def test_bootstrap_like_resampled_rows(spark, part):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key, n in (("a", 500), ("b", 37), ("c", 130)):
        y, s = (rng.random(n) < 0.2).astype(int), np.round(rng.random(n), 1 if key == "a" else 4)
        y = y * 0 if key == "c" else y
        rows += [(key, i, int(y[i]), float(s[i])) for i in range(n)]
        starts = evaluate.block_starts(n, 50, 20)
        assert starts.shape == (50, max(1, n // 20)) and starts.min() >= 0 and starts.max() <= n - 20
        aps = []
        for one in starts:
            at = np.concatenate([np.arange(a, min(a + 20, n)) for a in one])
            if 0 < y[at].sum() < len(at):
                aps.append(lstm.pr_area(y[at].astype(float), s[at]))
        want[key] = tuple(np.percentile(aps, [2.5, 97.5])) if aps else (None, None)
    df = spark.createDataFrame(rows, "k string, i long, y int, score double").repartition(3)
    got = {r["k"]: (r["pr_auc_lo"], r["pr_auc_hi"]) for r in evaluate.block_bootstrap(df, ["k"], df.groupBy("k").count().withColumnRenamed("count", "n_rows"), reps=50, block=20, part=part).collect()}
    assert got["c"] == want["c"] == (None, None)
    assert all(np.allclose(got[k], want[k]) for k in "ab")


def test_areas_are_both_areas(spark):
    rng = np.random.default_rng(11)
    rows = [(k, float(np.round(rng.random(), 2)), int(y)) for k, share in (("a", 0.2), ("b", 0.5), ("none", 0), ("all", 1)) for y in rng.random(300) < share]
    df = spark.createDataFrame(rows, "k string, score double, y int").repartition(3)
    got = {r["k"]: (r["pr_auc"], r["roc_auc"]) for r in evaluate.areas(df, ["k"]).collect()}
    pr, roc = ({r["k"]: r[c] for r in f(df, ["k"]).collect()} for c, f in (("pr_auc", evaluate.pr_auc), ("roc_auc", evaluate.roc_auc)))
    assert set(got) == {"a", "b", "none", "all"} and got["none"] == (None, None) and got["all"][1] is None
    for k in got:
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(got[k], (pr[k], roc[k]), strict=True))
    y, s = (np.array([r[i] for r in rows if r[0] == "a"]) for i in (2, 1))
    assert np.isclose(got["a"][0], lstm.pr_area(y.astype(float), s))
    assert np.isclose(got["a"][1], np.mean([(p > n) + (p == n) / 2 for p in s[y == 1] for n in s[y == 0]]))


def executed(df):
    """The names of a table's operators, as they are planned."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_plan_of_the_metrics_is_large(spark, monkeypatch):
    """The driver plans the parts of the metrics one by one: as one job they took more of its memory than it has."""
    rng = np.random.default_rng(3)
    p = [("r", h, "f", d, d * 48 + t, int(rng.random() < 0.2), float(rng.random())) for h in (1, 3) for d in range(4) for t in range(48)]
    from pyspark.sql import functions as F

    p = spark.createDataFrame(p, "run string, horizon int, fold string, day int, row long, y int, score double").withColumn("alarm", F.col("score") >= 0.9)
    onsets = spark.createDataFrame([("r", h, "f", 1, 60) for h in (1, 3)], "run string, horizon int, fold string, event int, row long")
    days = spark.createDataFrame([("r", "f", d) for d in range(4)], "run string, fold string, day int")
    sizes, keep = [], evaluate.kept

    def seen(df):
        sizes.append(len(executed(df).splitlines()))
        return keep(df)

    monkeypatch.setattr(evaluate, "kept", seen)
    out = evaluate.metrics(p, onsets, days, ["run"], reps=20, block=10)
    sizes.append(len(executed(out).splitlines()))
    assert out.count() == 2 and max(sizes) <= 40, sizes


def test_large_models_do_not_pass_the_driver(made, monkeypatch):
    level = made["blocks"].where("inputs = 'level' and fold = 'f1'")
    models = lstm.fit_models(level, tensors.MODEL, hidden=3, epochs=1, lookback=L).persist()
    gates = lambda: {tuple(r)[:-1]: r["mean"] for r in lstm.lstm_gates(level, models, tensors.MODEL, L).collect()}
    want = gates()
    # 192 models of the study's size are large.
    assert 192 * lstm.n_parameters(6, 64) > lstm.BROADCAST_NUMBERS
    monkeypatch.setattr(lstm, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(type(level.sparkSession.sparkContext), "broadcast", lambda *_: pytest.fail("the weights came to the driver"))
    got = gates()
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_rows_are_numbered_by_one_cut(spark, monkeypatch):
    """Approximate quantiles may differ from one reading to the next: here they do, and the numbers must not."""
    from pyspark.sql import functions as F

    def drawn(rows, *_):
        """The bound between two ranges, drawn anew whenever the rows are read."""

        def cut(frames):
            for pdf in frames:
                yield pdf.assign(_r=(pdf.row > np.random.default_rng().integers(100, 300)).astype("int32"))

        return rows.mapInPandas(cut, "k string, row long, _one long, _r int")

    monkeypatch.setattr(evaluate, "ranged", drawn)
    df = spark.range(0, 400, 1, 1).select(F.lit("a").alias("k"), F.col("id").alias("row"))
    for _ in range(3):
        assert [r["i"] for r in evaluate.row_numbers(df, ["k"], "row")[0].orderBy("row").collect()] == list(range(400))


def test_the_alarmed_share_needs_no_predictions(spark):
    from minutewise.plans import report

    p = spark.createDataFrame([("r", 1, i % 3 == 0, int(i % 5 == 0)) for i in range(70)], "run string, horizon int, alarm boolean, y int")
    m = evaluate.confusion(p, ["run", "horizon"])
    from pyspark.sql import functions as F

    m = m.withColumns({c: F.lit(0.5) for c in ("pr_auc", "pr_auc_lo", "pr_auc_hi", "pr_lift", "roc_auc", "false_alarms_per_day")} | {c: F.lit(1) for c in ("events_detected", "n_events")})
    assert report.metrics_table(m, keys=("run",)).collect() == report.metrics_table(m, p, ("run",)).collect()


def test_parts_stand_beside_each_other(spark):
    a = spark.createDataFrame([("x", 1, 5), ("y", 1, 6)], "k string, h int, tp int")
    b = spark.createDataFrame([("x", 1, 0.5), ("z", 2, None)], "k string, h int, auc double")
    assert {tuple(r) for r in evaluate.beside([a, b], ["k", "h"]).collect()} == {("x", 1, 5, 0.5), ("y", 1, 6, None), ("z", 2, None, None)}


def test_days_at_hand_are_not_read_from_the_events_again(spark):
    from minutewise.plans import report_queries

    days = spark.createDataFrame([(datetime.date(2024, 1, d),) for d in range(1, 11)], "day date")
    dealt = report_queries.folds(spark, "/no/such/folder", days)
    assert dealt.where("fold = 'chrono'").count() == 10 and dealt.where("kind = 'cv'").count() == 50
    assert report_queries.run_days_of(dealt, ["level"]).where("run = 'cv-level'").count() == 10
