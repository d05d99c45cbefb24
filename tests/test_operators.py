
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickforge.operators import backtest as BT
from tickforge.operators import features as FE
from tickforge.operators import quality as Q
from tickforge.operators.indicators import with_indicators
from tickforge.operators.series import fill


def bars(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(s, t0 + dt.timedelta(days=i), float(o), float(h), float(l), float(c), int(v))
            for s, i, o, h, l, c, v in rows]
    return spark.createDataFrame(
        data, "symbol string, ts timestamp_ntz, open double, high double, low double, "
              "close double, volume bigint")


def test_rsi_only_rising_is_100(spark):
    b = bars(spark, [("A", i, i, i + 1, i - 1, 10 + i, 100) for i in range(20)])
    out = with_indicators(b, ["rsi"]).orderBy("ts").collect()
    assert out[0]["RSI"] == 0.0  # first row: 0/0 -> 0
    assert all(r["RSI"] == 100.0 for r in out[1:])


def test_constant_close_and_zero_range(spark):
    b = bars(spark, [("A", i, 5, 5, 5, 5, 0) for i in range(15)])
    out = with_indicators(b, ["rsi", "stochastic_oscillator", "williams_r", "cmf", "adl", "obv"])
    r = out.orderBy("ts").collect()[-1]
    assert r["RSI"] == 0.0 and r["Stochastic"] == 0.0 and r["Williams_R"] == 0.0
    assert r["CMF"] is None  # zero volume: 0/0 -> null
    assert r["ADL"] == 0.0 and r["OBV"] == 0.0


def test_symbols_do_not_leak(spark):
    a = [("A", i, 1, 2, 0.5, 1 + i, 10) for i in range(12)]
    b_ = [("B", i, 100, 200, 50, 100 - i, 10) for i in range(12)]
    mixed = with_indicators(bars(spark, a + b_), ["sma", "ema", "obv"])
    alone = with_indicators(bars(spark, a), ["sma", "ema", "obv"])
    got = sorted(mixed.where("symbol = 'A'").collect())
    assert got == sorted(alone.collect())


def test_single_row_and_short_series(spark):
    b = bars(spark, [("A", 0, 1, 2, 0.5, 1.5, 10)])
    r = with_indicators(b, ["sma", "adx", "atr", "macd", "psar"]).collect()[0]
    assert r["SMA_10"] is None and r["ADX"] is None and r["ATR"] == 0.0
    assert r["MACD"] == 0.0 and r["PSAR"] == 1.5


def test_roc_zero_base_is_null(spark):
    rows = [("A", i, 1, 1, 1, 0.0 if i == 0 else 1.0, 1) for i in range(12)]
    out = with_indicators(bars(spark, rows), ["roc"], params={"roc": {"window": 10}})
    vals = [r["ROC"] for r in out.orderBy("ts").collect()]
    assert vals[:10] == [0.0] * 10 and vals[10] is None and vals[11] == 0.0


def test_fill_methods(spark):
    b = bars(spark, [("A", i, 1, 1, 1, 1, 1) for i in range(6)]).withColumn(
        "x", F.when(F.dayofmonth("ts").isin(2, 5), F.dayofmonth("ts").cast("double")))
    ff = [r["x_ffill"] for r in fill(b, "x", "ffill").orderBy("ts").collect()]
    bf = [r["x_bfill"] for r in fill(b, "x", "bfill").orderBy("ts").collect()]
    ip = [r["x_interpolate"] for r in fill(b, "x", "interpolate").orderBy("ts").collect()]
    assert ff == [None, 2.0, 2.0, 2.0, 5.0, 5.0]
    assert bf == [2.0, 2.0, 5.0, 5.0, 5.0, None]
    assert ip == [None, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_quality_frame(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a", 1), (2.0, 4.0, "b", 2), (None, None, "c", 2),
                                (4.0, 2.0, "d", 3), (5.0, 1.0, "e", 3)],
                               "A double, B double, C string, D int")
    assert Q.null_report(df).first()["any_null"] is True
    filled = Q.fill_missing_values(df)
    assert filled.where(F.col("A").isNull()).count() == 0
    assert filled.where("C = 'c'").first()["A"] == 3.0
    assert Q.duplicate_values(df, "D").count() == 2
    with pytest.raises(ValueError):
        Q.fill_missing_values(df, "constant")
    with pytest.raises(ValueError):
        Q.validate_schema(df, {"A": "string"})
    st = Q.standardize_column(df.na.drop(), "A").agg(F.avg("A_std"), F.stddev_samp("A_std")).first()
    assert abs(st[0]) < 1e-12 and abs(st[1] - 1) < 1e-12


def test_ledger_ramp(spark):
    t0 = dt.datetime(2024, 1, 1)
    acts = spark.createDataFrame(
        [("A", t0 + dt.timedelta(days=i), 0 if i == 0 else (1 if i == 9 else 2), 1.0,
          100.0 + i) for i in range(10)],
        "symbol string, ts timestamp_ntz, action_type int, amount double, price double")
    out = BT.action_ledger(acts).orderBy("ts").collect()
    assert out[0]["shares"] == 100.0  # floor(10000 / 100)
    # the fee drives the balance below zero (kept, and flagged)
    assert abs(out[0]["balance"] - (10000 - 100 * 100 * 1.001)) < 1e-9
    assert out[0]["negative_balance"] is True
    assert out[-1]["shares"] == 0.0
    assert abs(out[-1]["balance"] - (out[0]["balance"] + 100 * 109 * 0.999)) < 1e-9


def test_splits(spark):
    b = bars(spark, [("A", i, 1, 1, 1, i, 1) for i in range(10)])
    s = FE.split_chronological(b, 0.7)
    assert s.where("split = 'train'").count() == 7
    f = FE.time_series_folds(b, 3)
    assert f.where("fold = 0 AND role = 'test'").count() == 2  # 10 // 4


def test_vwap_day_anchor_and_interpolated_rolling(spark):
    t0 = dt.datetime(2024, 1, 1, 9)
    rows = [("A", t0 + dt.timedelta(hours=h), 1.0, 2.0 + h, 1.0, 1.5 + h, 10 + h)
            for h in range(30)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, "
                                    "low double, close double, volume bigint")
    day = with_indicators(b, ["vwap"], params={"vwap": {"anchor": "day"}}).orderBy("ts").collect()
    # the first bar of 2024-01-02 starts a new session: VWAP = its typical price
    first = next(r for r in day if r["ts"] == dt.datetime(2024, 1, 2))
    assert abs(first["VWAP"] - (17.0 + 1.0 + 16.5) / 3) < 1e-12
    r = FE.rolling_features(b, "close", (5,), method="interpolate").orderBy("ts").collect()
    assert [x["close_rolling_mean_5"] for x in r[:6]] == [None, None, None, None, 3.5, 4.5]


def test_exemplar_strategies_complete(spark):
    from __spark_entry__ import queries
    out = queries()["residual_exemplars"](spark, "/root/testdata/sf0.001")
    per = {r["strategy"] for r in out.select("strategy").distinct().collect()}
    assert per == {"worst", "best", "median", "q25", "q75", "outlier", "boundary_case",
                   "feature_extreme"}
    n_sym = out.select("symbol").distinct().count()
    assert out.count() == 8 * n_sym


def _ramp(spark, closes, symbol="A"):
    rows = [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), 10)
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, "
                                       "close double, volume bigint")


def test_ledger_values_the_position_at_the_next_bar(spark):
    from tickforge.operators.backtest import action_ledger
    bars = _ramp(spark, [100, 101, 102])
    acts = bars.selectExpr("symbol", "ts", "case when close = 100 then 0 else 1 end as action_type",
                           "0.5D as amount", "close as price")
    got = [(r.balance, r.shares, r.equity) for r in action_ledger(acts).orderBy("ts").collect()]
    bought = 10000 - 50 * 100 * 1.001
    sold = bought + 25 * 101 * 0.999
    last = sold + 12.5 * 102 * 0.999
    want = [(bought, 50, bought + 50 * 101), (sold, 25, sold + 25 * 102), (last, 12.5, last + 12.5 * 102)]
    assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r])


def test_psar_of_a_rise_and_a_fall(spark):
    from tickforge.operators.fold import StopAndReverse
    for textbook in (False, True):
        s = StopAndReverse(0.02, 0.2, textbook)
        out = [s.begin(11, 9, 10)] + [s.advance(p + 1, p - 1) for p in (13, 15, 17, 5, 4)]
        assert out[1] == 9  # never above the low of the bar before
        assert s.side == -1 and out[4] == 18  # reversed at the highest high
    assert s.speed > 0.02  # the textbook rule speeds up on each new low


def test_per_symbol_fit_with_two_features_and_far_origin(spark):
    from tickforge.operators.models import per_symbol_ols
    rows = [(s, 1e6 + i, float(i * i % 7), 3.0 + a * (1e6 + i) - 2.0 * (i * i % 7))
            for s, a in (("A", 2.0), ("B", 5.0)) for i in range(50)] + [("A", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, x double, z double, y double")
    got = {r.symbol: r for r in per_symbol_ols(df, ["x", "z"], "y").collect()}
    for s, a in (("A", 2.0), ("B", 5.0)):
        assert [got[s].coef_x, got[s].coef_z] == pytest.approx([a, -2.0], rel=1e-6)
        assert got[s].intercept == pytest.approx(3.0, abs=0.1)


def test_search_survives_a_failing_trial(spark):
    from tickforge.operators.models import best_parameters, hyperparameter_search, trial_points
    df = spark.createDataFrame([(float(i), float(i % 5), 2.0 * i) for i in range(60)], "a double, b double, y double")
    out = hyperparameter_search(df, ["a", "b"], "y", {"numTrees": [2], "maxDepth": [2, 99]}, n_trials=2, folds=2)
    got = {r.params_maxDepth: r for r in out.collect()}
    assert got[99].state == "FAIL" and got[99].value == float("inf") and got[2].state == "COMPLETE"
    assert best_parameters(out) == {"numTrees": 2, "maxDepth": 2}
    points = trial_points({"numTrees": ("int", 2, 4), "minInfoGain": ("float", 0.0, 0.1)}, 5)
    assert len(points) == 5 and all(2 <= n <= 4 and 0 <= g <= 0.1 for n, g in points)


def test_raising_checks(spark):
    from tickforge.operators.backtest import risk_status
    df = spark.createDataFrame([("A", 1.0), ("B", float("nan"))], "k string, x double")
    with pytest.raises(ValueError, match="not finite"):
        Q.assert_finite(df)
    Q.assert_finite(df.where("k = 'A'"))
    with pytest.raises(ValueError, match="stop_loss"):
        risk_status(_ramp(spark, [1, 2]), stop_loss=1.5)


def test_mode_fill_takes_the_smallest_of_the_most_frequent(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,), ("c",)], "k string")
    assert sorted(r.k for r in Q.fill_missing_values(df).collect()) == ["a", "a", "a", "b", "b", "c"]


def test_rsi_variants_side_by_side(spark):
    bars = _ramp(spark, [10, 11, 10, 12, 11, 13])
    both = with_indicators(bars, ["rsi", "rsi_custom", "rsi_strict"], params={
        n: {"window": 3} for n in ("rsi", "rsi_custom", "rsi_strict")}).orderBy("ts").collect()
    alone = with_indicators(bars, ["rsi_strict"], params={"rsi_strict": {"window": 3}}).orderBy("ts").collect()
    assert [r.RSI_strict for r in both] == [r.RSI for r in alone]
    assert both[0].RSI_strict is None and both[0].RSI_custom == 0.0 and both[-1].RSI == both[-1].RSI_custom


def test_backtest_report_of_a_replay(spark):
    """Summary and step arrays against plain numpy, with and without blocks and small parts."""
    import numpy as np
    rng = np.random.default_rng(4)
    closes = {"A": (100 + np.cumsum(rng.normal(size=70))).tolist(), "B": [50.0, 60.0, 55.0]}
    bars = _ramp(spark, closes["A"]).union(_ramp(spark, closes["B"], "B"))
    ledger = BT.action_ledger(BT.momentum_actions(bars))
    rows = sorted(ledger.collect(), key=lambda r: (r.symbol, r.ts))
    for kw in ({}, {"block_rows": 16, "chunk": 9}):
        summary, steps = BT.backtest_report(ledger, **kw)
        got = {r.symbol: r for r in summary.collect()}
        parts = sorted(steps.collect(), key=lambda r: (r.symbol, r.part))
        assert len(got) == 2
        for s, close in closes.items():
            mine = [r for r in rows if r.symbol == s]
            prices = np.array([*close[1:], close[-1]])
            total = np.cumsum([r.reward for r in mine])
            assert [x for p in parts if p.symbol == s for x in p.step_rewards] == pytest.approx(total.tolist())
            assert [x for p in parts if p.symbol == s for x in p.step_prices] == prices.tolist()
            assert [p.part for p in parts if p.symbol == s] == list(range(-(-len(close) // kw.get("chunk", 1 << 16))))
            before, change = total[:-1], np.diff(total)
            excess = change[before != 0] / before[before != 0] - 0.01 / 252
            peak = np.maximum.accumulate(prices)
            assert (got[s].steps, got[s].final_balance, got[s].final_equity) == (len(close), mine[-1].balance, mine[-1].equity)
            assert [got[s].mfe, got[s].mae, got[s].max_drawdown, got[s].total_reward] == pytest.approx(
                [prices.max() - prices[0], prices[0] - prices.min(), ((peak - prices) / peak).max(), total[-1]])
            if s == "A":
                assert got[s].sharpe_ratio == pytest.approx(excess.mean() / excess.std() * 252 ** 0.5, rel=1e-6)
                assert got[s].sortino_ratio == pytest.approx(excess.mean() / excess[excess < 0].std() * 252 ** 0.5, rel=1e-6)
    assert all(d.count() == 0 for d in BT.backtest_report(ledger.limit(0)))
