"""Folds in blocks from guessed entry states must equal the fold in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import backtest as BT
from tickforge.operators import fold
from tickforge.sources.tables import event_bars, line_bars

from conftest import SF01


def walk(spark, n, seed=3):
    """Random walks of a long, a short and a one-bar symbol, five minutes a bar."""
    rng = np.random.default_rng(seed)
    rows = []
    for s, k in (("hot", n), ("b", n // 4), ("one", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, k)))
        span = np.abs(rng.normal(0, 0.5, (2, k)))
        rows += [(s, i * 300, float(c + u), float(c - d), float(c)) for i, (c, u, d) in enumerate(zip(close, *span))]
    df = spark.createDataFrame(rows, "symbol string, sec long, high double, low double, close double")
    return df.select("symbol", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "high", "low", "close")


def same(a, b, cols):
    a, b = (sorted(map(tuple, df.select("symbol", "ts", *cols).collect())) for df in (a, b))
    assert a == b


@pytest.mark.parametrize("textbook", [False, True])
def test_psar_in_blocks(spark, textbook):
    bars = walk(spark, 2400).cache()
    plain = fold.psar(bars, textbook=textbook)
    same(fold.psar(bars, textbook=textbook, block_rows=200), plain, ["PSAR"])


def test_psar_of_bars_in_blocks(spark):
    bars = event_bars(spark, SF01)
    same(fold.psar(bars, block_rows=64), fold.psar(bars), ["PSAR"])


def test_blocks_that_forget_run_at_once(spark):
    """A stop forgets its entry: few rounds, few blocks again. A ledger does not: one block of a series a round."""
    bars = walk(spark, 2400).cache()

    def last_hundred(state, pdf):  # forgets after five rows
        seen = [] if state is None else list(state)
        out = []
        for c in pdf["close"]:
            seen = (seen + [c])[-5:]
            out.append(sum(seen))
        return {"total": out}, seen

    def running(state, pdf):
        total, out = 0.0 if state is None else state[0], []
        for c in pdf["close"]:
            total += c
            out.append(total)
        return {"total": out}, [total]
    from pyspark.sql import types as T
    field = [T.StructField("total", T.DoubleType())]
    for run, most in ((last_hundred, 2), (running, 9)):
        seen = []
        got = fold.fold_blocks(bars, ["symbol"], "ts", run, field, block_rows=300, seen=seen)
        same(got, fold.fold_series(bars, ["symbol"], "ts", run, field), ["total"])
        assert len(seen) <= most and seen[0] == 8 + 2 + 1
        assert sum(seen) <= 4 * seen[0]


def test_short_series_share_a_group(spark):
    """Many series in few groups, also over the borders of small batches, equal one series alone."""
    bars = walk(spark, 120).where("symbol = 'hot'")
    many = bars.crossJoin(spark.range(150).select(F.concat(F.lit("s"), F.col("id")).alias("s"))).withColumn("symbol", F.col("s")).drop("s")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((r.ts, r.PSAR) for r in fold.psar(bars).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        got = {}
        for r in fold.psar(many).collect():
            got.setdefault(r.symbol, []).append((r.ts, r.PSAR))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 150 and all(sorted(v) == want for v in got.values())
    assert "FlatMapGroupsInPandas [symbol" not in fold.psar(many)._jdf.queryExecution().toString()


def test_ledger_in_blocks(spark):
    actions = BT.momentum_actions(walk(spark, 700)).cache()
    cols = ["balance", "shares", "equity", "reward", "negative_balance"]
    same(BT.action_ledger(actions, block_rows=200), BT.action_ledger(actions), cols)


def test_rows_without_key_or_time_and_empty_tables(spark):
    bars = walk(spark, 40)
    odd = bars.union(bars.limit(1).withColumn("symbol", F.lit(None).cast("string"))).union(
        bars.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    for rows in (1 << 20, 8):
        same(fold.psar(odd, block_rows=rows), fold.psar(bars), ["PSAR"])
        assert fold.psar(bars.limit(0), block_rows=rows).count() == 0
    with pytest.raises(Exception, match="time order"):
        fold.psar(bars.union(bars)).count()
