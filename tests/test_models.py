"""Feature pipeline, search, forecasts, synthesis and exemplars against plain Python on small tables."""

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import models as M
from tickforge.operators import sampler as S
from tickforge.operators.forecast import UNIT_ROOT_5, walk_forward
from tickforge.operators.preprocess import FeaturePipeline, FeaturePipelineModel, preprocess
from tickforge.operators.quality import label_encode
from tickforge.operators.synthesis import deep_features, plan
from tickforge.session import scratch_path

DAY = dt.datetime(2024, 1, 1)


def _bars(spark, series, extra=None):
    rows = [(s, DAY + dt.timedelta(days=i), float(v), *((extra(s, i),) if extra else ()))
            for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double" + (", note string" if extra else ""))


def _walks(seed=1, n=60):
    rng = np.random.default_rng(seed)
    return {s: 100 + np.cumsum(rng.normal(size=n)) for s in ("A", "B")}


# ------------------------------------------------------------------ feature pipeline
def _note(s, i):
    return ("x" if s == "A" else "y") if i % 3 else str(i)


def test_pipeline_is_saved_and_scores_new_rows(spark):
    bars = _bars(spark, _walks(), _note)
    est = FeaturePipeline(lags=[1, 2], windows=[3], scaler="minmax", by=["symbol"])
    model = est.fit(bars)
    path = scratch_path(spark, "pipeline")
    model.write().save(path)
    again = FeaturePipelineModel.load(path)
    want = model.transform(bars).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    got = again.transform(bars).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert got.equals(want)
    assert preprocess(bars, "close", (1, 2), (3,), scaler="minmax", by=["symbol"]).toPandas().sort_values(
        ["symbol", "ts"], ignore_index=True).equals(want)
    # by hand: 58 whole rows a symbol, the first 46 train
    for s, g in want.groupby("symbol"):
        assert (g.split == "train").sum() == math.floor(58 * 0.8)
        close = _walks()[s]
        lag = close[1:-1]
        fit = lag[:46]
        assert np.allclose(g.close_lag_1, (lag - fit.min()) / (fit.max() - fit.min()))
        days = np.arange(2, 60)
        assert np.allclose(g.days_since, (days - 2) / 45)
        note = np.array([float(i) if i % 3 == 0 else np.nan for i in days])
        note = np.where(np.isnan(note), np.nanmean(note[:46]), note)
        assert np.allclose(g.note, (note - note[:46].min()) / (note[:46].max() - note[:46].min()))
    # rows after the fit and an unknown symbol are test rows; nothing is fitted anew
    later = _bars(spark, {"A": list(_walks()["A"]) + [1e6] * 5, "Z": range(10)}, _note)
    out = again.transform(later).toPandas()
    assert set(out[out.symbol == "Z"].split) == {"test"}
    old = out[(out.symbol == "A")].sort_values("ts").head(58)
    assert np.allclose(old.close_lag_1, want[want.symbol == "A"].close_lag_1)


def test_pipeline_fits_on_all_rows_or_train_rows(spark):
    bars = _bars(spark, {"A": np.arange(40.0)})
    train = preprocess(bars, "close", (1,), (2,)).agg(F.max("close_lag_1")).first()[0]
    both = preprocess(bars, "close", (1,), (2,), fit_on="all").agg(F.max("close_lag_1")).first()[0]
    lag = np.arange(39.0)
    fit = lag[:31]
    assert train == pytest.approx((lag[-1] - fit.mean()) / fit.std())
    assert both == pytest.approx((lag[-1] - lag.mean()) / lag.std())


def test_pipeline_codes_nulls_empty_tables_and_odd_columns(spark):
    bars = _bars(spark, _walks(), lambda s, i: None if i % 7 == 0 else "cab"[i % 3])
    bars = bars.withColumn("words", F.lit("none")).withColumn("split", F.lit(2.0)).withColumn("_pos", F.lit(1.0))
    with pytest.raises(ValueError, match="reserved"):
        preprocess(bars, "close", (1,), (2,))
    bars = bars.drop("split", "_pos")
    out = preprocess(bars, "close", (1,), (2,), scaler="maxabs", encode=["note"]).toPandas()
    assert "words" not in out.columns  # not one number in it
    assert not out.isna().any().any() and {0.0, 0.5, 1.0} <= set(out.note)
    empty = preprocess(bars.limit(0), "close", (1,), (2,))
    assert empty.count() == 0
    with pytest.raises(ValueError, match="scaler"):
        preprocess(bars, scaler="none")
    blocked = preprocess(bars.drop("note"), "close", (1, 2), (3,), block_rows=16).toPandas()
    plain = preprocess(bars.drop("note"), "close", (1, 2), (3,)).toPandas()
    key = ["symbol", "ts"]
    a, b = (x.sort_values(key, ignore_index=True) for x in (blocked, plain))
    assert (a.split == b.split).all() and np.allclose(a.close_lag_2, b.close_lag_2)


def test_label_codes_are_dense_and_sorted_without_a_single_partition(spark):
    rows = [(i, f"k{(i * 7919) % 500:03d}") for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, k string").repartition(7)
    out = label_encode(df, "k")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.k_code) for r in out.collect()}
    names = sorted({k for _, k in rows if k})
    assert got == {(k, i) for i, k in enumerate(names)} | {(None, None)}
    assert label_encode(df.limit(0), "k").count() == 0


# ------------------------------------------------------------------ search and forest
def test_sampler_beats_random_draws_on_a_planted_optimum():
    space = {"x": ("float", -10.0, 10.0), "n": ("int", 0, 50), "c": ["a", "b", "c", "d"]}

    def loss(p):
        x, n, c = p
        return (x - 3) ** 2 + ((n - 40) / 5) ** 2 + (0 if c == "c" else 20)

    late, best, drawn = [], [], []
    for seed in range(8):
        history = []
        for _ in range(60):
            p = S.next_point(space, history, seed)
            history.append((p, loss(p)))
        again = []
        for p, v in history:
            assert S.next_point(space, again, seed) == p  # the same history gives the same point
            again.append((p, v))
        late.append(np.mean([v for _, v in history[-20:]]))
        best.append(min(v for _, v in history))
        drawn.append([loss(p) for p in S.trial_points(space, 60, seed + 100)])
    assert np.mean(late) < 0.4 * np.mean(drawn)
    assert np.mean(best) < np.mean([min(d) for d in drawn])


def test_sampler_ends_with_a_finite_space_and_takes_failures_for_bad():
    space = {"a": [1, 2, 3], "b": [True, False]}
    history = []
    while (p := S.next_point(space, history, startup=2)) is not None:
        history.append((p, math.inf if p[0] == 3 else float(p[0])))
    assert sorted(p for p, _ in history) == sorted((a, b) for a in (1, 2, 3) for b in (True, False))


def test_parameter_check():
    space = {"n": ("int", 1, 5), "f": ("float", 0.0, 1.0), "c": ["a"]}
    S.check_parameters({"n": 3, "f": 1, "c": "a"}, space)
    for bad in ({"n": 3, "f": 1}, {"n": 9, "f": 1, "c": "a"}, {"n": 3.5, "f": 1, "c": "a"}, {"n": 3, "f": 1, "c": "z"}):
        with pytest.raises(ValueError):
            S.check_parameters(bad, space)


def test_time_folds_expand(spark):
    bars = _bars(spark, {"A": range(23), "B": range(3)})
    got = {}
    for r in M.time_slots(bars, 4, "symbol", "ts").collect():
        got.setdefault(r.symbol, {})[r.close] = r._slot
    assert [got["A"][float(i)] for i in range(23)] == [0] * 7 + [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4
    assert set(got["B"].values()) == {0}  # too short for a fold: trains only


def test_only_parameter_errors_are_failed_trials(spark):
    df = _bars(spark, _walks()).withColumn("x", F.col("close") * 2)
    space = {"numTrees": [2], "maxDepth": [2, 99]}
    trials = M.hyperparameter_search(df, ["x"], "close", space, n_trials=5, folds=2, ts="ts")
    assert sorted(r.state for r in trials.collect()) == ["COMPLETE", "FAIL"]
    path = scratch_path(spark, "trials")
    M.write_trials(trials, path)
    dumped = [json.loads(line) for f in os.listdir(path.replace("file:", "")) if f.endswith(".json")
              for line in open(os.path.join(path.replace("file:", ""), f))]
    assert len(dumped) == 2 and all(d["params"]["numTrees"] == 2 for d in dumped)
    broken = df.withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        M.hyperparameter_search(broken, ["x"], "close", space, n_trials=1, folds=2, ts="ts")


def test_registered_search_is_the_whole_study(spark, monkeypatch):
    from tickforge.plans import catalog_analytics as CA
    asked = {}
    monkeypatch.setattr(CA.M, "hyperparameter_search", lambda *a, **kw: asked.update(kw) or "trials")
    assert CA.q_search(spark, "/root/testdata/sf0.001") == "trials"
    assert (asked["n_trials"], asked["folds"]) == (100, 5) and asked["startup"] >= 10


def test_search_values_do_not_depend_on_how_many_fits_run_at_once(spark, monkeypatch):
    df = _bars(spark, _walks()).withColumn("x", F.col("close") * 2)
    space = {"numTrees": ("int", 1, 2), "maxDepth": ("int", 1, 2)}
    fits, error = [], M._fold_error
    monkeypatch.setattr(M, "_fold_error", lambda est, *a: fits.append((est.getNumTrees(), est.getMaxDepth(), a[2])) or error(est, *a))
    got = []
    for parallelism in (1, 4):
        fits.clear()
        trials = M.hyperparameter_search(df, ["x"], "close", space, n_trials=9, folds=2, ts="ts", startup=4,
                                         parallelism=parallelism)
        got.append([(r.number, r.value, r.params_numTrees, r.params_maxDepth, r.state) for r in trials.orderBy("number").collect()])
        tried = {(r[2], r[3], i) for r in got[-1] for i in (0, 1)}
        assert len(got[-1]) == 9 and set(fits) == tried and len(fits) == len(tried)  # a point drawn again is not fitted again
    assert got[0] == got[1]


def test_tuned_forest_predicts_better_than_the_mean(spark):
    rng = np.random.default_rng(5)
    rows = [("A", DAY + dt.timedelta(days=i), float(x), float(z), float(3 * x + 0.1 * z))
            for i, (x, z) in enumerate(rng.uniform(size=(300, 2)))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, z double, y double")
    done = M.tuned_forest(df, ["x", "z"], "y", {"numTrees": ("int", 3, 8), "maxDepth": ("int", 2, 6)}, n_trials=4,
                          folds=2, startup=2)
    p = done.predictions.toPandas()
    train = np.array([r[4] for r in rows[:240]])
    assert len(p) == 60 and p.prediction.between(train.min(), train.max()).all()
    assert ((p.y - p.prediction) ** 2).mean() < 0.2 * ((p.y - train.mean()) ** 2).mean()
    imp = [(r.feature, r.importance) for r in done.importances.collect()]
    assert imp[0][0] == "x" and imp[0][1] > imp[1][1] and sum(v for _, v in imp) == pytest.approx(1)
    assert done.trials.count() == 4


def test_ridge_penalty_is_on_the_sum_of_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2)) * [1, 20]
    y = x @ [300.0, -5.0] + rng.normal(size=50) * 40
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.5, 50.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        got = M.fit_ridge(df, ["a", "b"], "y", alpha).stages[-1].coefficients.toArray()
        assert np.allclose(got, want, rtol=1e-8)


# ------------------------------------------------------------------ exemplars
def test_cluster_exemplars_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(c, 0.5, size=(40, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    err = rng.normal(size=120) + np.repeat([0, 5, 0], 40)
    rows = [("A", DAY + dt.timedelta(days=i), float(a), float(b), float(e)) for i, ((a, b), e) in enumerate(zip(pts, err))]
    df = spark.createDataFrame(rows + [("A", DAY, None, 1.0, 99.0)], "symbol string, ts timestamp, a double, b double, e double")
    out, centres = M.cluster_exemplars(df, ["a", "b"], "e", 3)
    got = {r.strategy: r for r in out.collect()}
    d = np.sqrt(((pts[:, None, :] - np.array(centres)[None]) ** 2).sum(-1))
    mine = d.argmin(1)
    near = d.min(1).argmin()
    worst = max(range(3), key=lambda c: np.abs(err)[mine == c].mean())
    row = max(np.flatnonzero(mine == worst), key=lambda i: abs(err[i]))
    assert got["cluster_center"].ts == DAY + dt.timedelta(days=int(near))
    assert got["cluster_center"].score == pytest.approx(d.min())
    assert got["cluster_error"].ts == DAY + dt.timedelta(days=int(row)) and got["cluster_error"].cluster == worst
    assert M.cluster_exemplars(df.limit(0), ["a", "b"], "e")[0].count() == 0


# ------------------------------------------------------------------ forecasts
def _forecast(close, threshold):
    close = np.array(close)
    n = math.floor(len(close) * 0.8)
    m, s = close[:n].mean(), close[:n].std() or 1.0
    d, y = np.diff(close[:n]), close[:n - 1]
    sxx = ((y - y.mean()) ** 2).sum()
    b = ((y - y.mean()) * (d - d.mean())).sum() / sxx if sxx else math.nan
    res = ((d - d.mean()) ** 2).sum() - b * b * sxx
    steady = sxx > 0 and b / math.sqrt(res / (len(d) - 2) / sxx) < UNIT_ROOT_5
    z = (close - m) / s
    x = z if steady else np.concatenate([[math.nan], np.diff(z)])
    out = {}
    for t in range(n, len(close)):
        pairs = [(x[i - 1], x[i]) for i in range(1, t) if not math.isnan(x[i - 1])]
        px, py = np.array(pairs).T
        if ((px - px.mean()) ** 2).sum() == 0:
            continue
        slope = ((px - px.mean()) * (py - py.mean())).sum() / ((px - px.mean()) ** 2).sum()
        out[t] = py.mean() + slope * (x[t - 1] - px.mean()) + (0 if steady else z[t - 1])
    mse = np.mean([(z[t] - v) ** 2 for t, v in out.items()]) if out else None
    return {t: m + s * v for t, v in out.items()}, steady, mse, mse is not None and mse <= threshold


@pytest.mark.parametrize("block_rows", [None, 12])
def test_walk_forward_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    noise = [0.0]
    for _ in range(119):
        noise.append(0.2 * noise[-1] + rng.normal())
    series = {"walk": 1e6 + np.cumsum(rng.normal(0.5, 1, size=120)), "noise": 50 + np.array(noise), "flat": [7.0] * 30,
              "short": [1.0, 2.0]}
    kw = {"block_rows": block_rows} if block_rows else {}
    bars = _bars(spark, series).unionByName(_bars(spark, {"walk": [float("nan")]}).withColumn("close", F.lit(None).cast("double")))
    got = walk_forward(bars, threshold=0.5, **kw).toPandas()
    assert set(got.symbol) == {"walk", "noise"}
    for name in ("walk", "noise"):
        want, steady, mse, accepted = _forecast(series[name], 0.5)
        g = got[got.symbol == name].sort_values("ts")
        assert steady == (name == "noise") and set(g.differenced) == {not steady}
        assert np.allclose(g.predicted, list(want.values()), rtol=0, atol=1e-8 * max(1, abs(series[name]).max() / 100))
        assert np.allclose(g.mse, mse) and set(g.accepted) == {accepted}
    assert walk_forward(bars.limit(0)).count() == 0


# ------------------------------------------------------------------ synthesis
def test_synthesis_stacks_to_its_depth(spark):
    one, two = plan(["close"], max_depth=1), plan(["close"], max_depth=2)
    assert [f for f in two if f.depth == 1] == [f for f in one]
    assert {"MEAN(CUM_SUM(close))", "CUM_MEAN(CUM_SUM(close))"} <= {f.name for f in two} - {f.name for f in one}
    bars = _bars(spark, {"A": [1, 2, 4, 8, 16], "B": [3]})
    for kw in ({}, {"block_rows": 2}):
        got = {r.ts.day: r for r in deep_features(bars, ["close"], 2, **kw).where("symbol = 'A'").collect()}
        run = np.cumsum([1, 2, 4, 8, 16])
        assert [got[i]["CUM_SUM(CUM_SUM(close))"] for i in range(1, 6)] == list(np.cumsum(run))
        assert [got[i]["CUM_MEAN(close)"] for i in range(1, 6)] == list(run / np.arange(1, 6))
        assert got[1]["MAX(CUM_SUM(close))"] == 31 and got[1]["MEAN(CUM_SUM(close))"] == run.mean()
        assert got[3]["DAY(ts)"] == 3
    with pytest.raises(ValueError, match="primitive"):
        plan(["close"], transforms=("LOG",))


# ------------------------------------------------------------------ episodes and sequences
def test_a_stop_sells_everything(spark):
    from tickforge.operators.backtest import risk_parameters, risk_truncate
    rows = [(s, DAY + dt.timedelta(days=i), st, 100.0, 5.0, 400.0) for s, end in
            (("A", "STOP_LOSS"), ("B", "STOP_TRADING"), ("C", "CONTINUE_TRADING"))
            for i, st in enumerate(["CONTINUE_TRADING", end, "TAKE_PROFIT" if s != "C" else end])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, status string, balance double, shares double, equity double")
    got = {}
    for r in risk_truncate(df).orderBy("symbol", "ts").collect():
        got.setdefault(r.symbol, []).append((r.balance, r.shares, r.equity))
    cash = 100 + 300 * 0.999
    assert got["A"] == [(100, 5, 400), (pytest.approx(cash), 0, pytest.approx(cash))]
    assert got["B"] == [(100, 5, 400)] * 2 and got["C"] == [(100, 5, 400)] * 3
    with pytest.raises(ValueError, match="take_profit"):
        risk_parameters(df, take_profit=0.0)


def test_scaled_sequences_have_a_target_scaler_of_their_own(spark):
    from tickforge.operators.features import inverse_scaler, scaled_sequences
    bars = _bars(spark, {"A": range(20), "B": [4.0] * 3}).withColumn("volume", F.col("close") * 10)
    bars = bars.unionByName(_bars(spark, {"A": [float("inf")]}).withColumn("volume", F.lit(1.0)))
    seq, target = scaled_sequences(bars, ("volume",), "close", 4, 0.5)
    rows = seq.orderBy("ts").collect()
    assert [r.split for r in rows] == ["train"] * 8 + ["test"] * 8  # 16 sequences of A, none of B
    assert rows[0].X == [[i / 11, i / 11] for i in range(4)] and rows[-1].y == pytest.approx(19 / 11)
    back = inverse_scaler(seq.drop("close").withColumnRenamed("y", "close"), target, ["close"], "minmax", ["symbol"])
    assert [r.close_inv for r in back.orderBy("ts").collect()] == pytest.approx(list(range(4, 20)))


def test_every_symbol_has_its_own_threshold(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(x), float(2 * x + e)) for s in "ABC" for x, e in rng.normal(size=(40, 2))] + [("A", None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, x double, y double")
    limits = spark.createDataFrame([("A", 100.0), ("B", 1e-6), ("D", 1.0)], "symbol string, threshold double")
    got = {r.symbol: r for r in M.train_per_symbol(df, ["x"], "y", limits).collect()}
    assert set(got) == {"A", "B"} and got["A"].accepted and not got["B"].accepted
    x, y = np.array([r[1:] for r in rows if r[0] == "A" and r[1] is not None]).T
    slope, cut = np.polyfit(x, y, 1)
    assert got["A"].coef_x == pytest.approx(slope) and got["A"].mse == pytest.approx(((y - slope * x - cut) ** 2).mean())
