"""Exponential means of inputs with nulls: pandas' ewm is the reference."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.operators.indicators import with_indicators
from tickforge.sources.tables import event_bars

from conftest import SF01


def bars_with_nulls(spark):
    """Leading nulls, single ones, long runs (longer than a block and a sub-block) and a symbol without values."""
    rng = np.random.default_rng(2)
    rows = []
    for s, n in (("A", 3000), ("B", 200), ("C", 1), ("D", 40)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        volume = rng.integers(1, 1000, n).astype(float)
        for i in range(n):
            gone = s == "D" or i < (11 if s == "A" else 3) or i % 13 == 7 or 400 <= i < 1700 or (s == "B" and i > 150)
            rows.append((s, i * 60, None if gone and s != "C" else float(close[i]), None if i % 7 == 3 or i < 2 else int(volume[i])))
    df = spark.createDataFrame(rows, "symbol string, sec long, close double, volume long")
    return df.select("symbol", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "close", "volume")


def expected(pdf):
    out = []
    for _, g in pdf.sort_values("ts").groupby("symbol"):
        g = g.copy()

        def mean(x, span):
            return x.ewm(span=span, adjust=False).mean()
        close, volume = g["close"].astype(float), g["volume"].astype(float)
        g["EMA_10"] = mean(close, 10)
        g["MACD"] = mean(close, 12) - mean(close, 26)
        g["MACD_Signal"] = mean(g["MACD"], 9)
        g["MACD_Hist"] = g["MACD"] - g["MACD_Signal"]
        e3 = mean(mean(mean(close, 15), 15), 15)
        g["TRIX"] = 100 * (e3 / e3.shift(1) - 1)
        g["TRIX_signal"] = mean(g["TRIX"], 9)
        g["Volume_Oscillator"] = mean(volume, 12) - mean(volume, 26)
        out.append(g)
    return pd.concat(out)


COLS = ["EMA_10", "MACD", "MACD_Signal", "MACD_Hist", "TRIX", "TRIX_signal", "Volume_Oscillator"]


@pytest.mark.parametrize("block_rows", [None, 700])
def test_means_of_inputs_with_nulls(spark, block_rows):
    bars = bars_with_nulls(spark).cache()
    kw = {} if block_rows is None else {"block_rows": block_rows}
    got = with_indicators(bars, ["ema", "macd", "trix", "volume_oscillator"], **kw).select("symbol", "ts", *COLS).toPandas()
    want = expected(bars.toPandas()).sort_values(["symbol", "ts"])
    got = got.sort_values(["symbol", "ts"])
    assert len(got) == len(want)
    for c in COLS:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("window", [1, 2, 3, 200])
def test_spans_with_nulls(spark, window):
    bars = bars_with_nulls(spark)
    got = with_indicators(bars, ["ema"], params={"ema": {"window": window}}).toPandas().sort_values(["symbol", "ts"])
    want = bars.toPandas().sort_values(["symbol", "ts"]).groupby("symbol")["close"].transform(
        lambda x: x.astype(float).ewm(span=window, adjust=False).mean())
    np.testing.assert_allclose(got[f"EMA_{window}"].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_weighted_form_equals_the_plain_one_without_nulls(spark):
    """One null elsewhere must not change the other symbols."""
    bars = event_bars(spark, SF01)
    names = ["ema", "macd", "trix", "volume_oscillator"]
    plain = with_indicators(bars, names).toPandas()
    other = bars.limit(1).withColumn("symbol", F.lit("other")).withColumn("close", F.lit(None).cast("double"))
    gaps = with_indicators(bars.unionByName(other), names).where("symbol <> 'other'").toPandas()
    plain, gaps = (x.sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (plain, gaps))
    for c in COLS:
        np.testing.assert_allclose(gaps[c].to_numpy(float), plain[c].to_numpy(float), rtol=1e-9, atol=1e-7, err_msg=c)
