"""The blocked layout must give exactly the plain per-symbol result."""

import pytest
from pyspark.sql import functions as F

from tickforge.operators.indicators import output_columns, with_indicators
from tickforge.plans.layout import lay_out
from tickforge.sources.tables import event_bars, line_bars

from conftest import SF001, SF01


def _same(a, b, cols):
    """The same rows, numbers but for 1e-9 of their size (rounding to digits can split equal ones)."""
    a, b = (sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: r[:2]) for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2]
        assert [v is None for v in x] == [v is None for v in y], (x, y)
        assert [v for v in x[2:] if v is not None] == pytest.approx([v for v in y[2:] if v is not None], rel=1e-9, abs=1e-8), (x, y)


def _rows(df, cols, digits=6):
    sel = [F.round(F.col(c), digits).alias(c) if c not in ("symbol", "ts") else F.col(c)
           for c in cols]
    return sorted(tuple(r) for r in df.select(*sel).collect())


def test_row_numbers_exact(spark):
    bars = event_bars(spark, SF01)
    laid = lay_out(bars, halo=5, block_rows=16)
    assert laid.blocked
    got = laid.df.where("_own").select("symbol", "ts", "_rn")
    ref = lay_out(bars, blocked=False).df.select("symbol", "ts", "_rn")
    assert sorted(got.collect()) == sorted(ref.collect())
    # several blocks per symbol, and halo copies exist
    assert laid.df.select("symbol", "_blk").distinct().count() > 20
    assert laid.df.where(~F.col("_own")).count() > 0


@pytest.mark.parametrize("names", [
    ["sma", "rsi", "stochastic_oscillator", "williams_r", "roc", "bollinger"],
    ["obv", "vwap", "adl", "cmf", "mfi", "historical_volatility"],
    ["ema", "macd"],
    ["trix", "volume_oscillator"],
    ["atr", "keltner", "chandelier_exit"],
    ["adx", "ichimoku"],
])
def test_blocked_equals_plain(spark, names):
    bars = event_bars(spark, SF01)
    cols = ["symbol", "ts"] + [c for n in names for c in output_columns(n)]
    plain = with_indicators(bars, names, blocked=False)
    blocked = with_indicators(bars, names, block_rows=16)
    _same(blocked, plain, cols)


def test_suite_runs_on_small_bars(spark):
    out = with_indicators(line_bars(spark, SF001))
    assert "PSAR" in out.columns and "VWAP" in out.columns
    assert out.count() == line_bars(spark, SF001).count()


def test_value_ordered_asof_blocked_equals_plain(spark):
    """The as-of search over values (exemplar novelty) on tiny blocks."""
    from tickforge.operators.features import split_chronological
    from tickforge.operators.models import novelty_exemplar
    s = split_chronological(event_bars(spark, SF01), 0.8)
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    plain = novelty_exemplar(tr, te, "close", blocked=False)
    blocked = novelty_exemplar(tr, te, "close", block_rows=16)
    cols = ["symbol", "ts", "dist"]
    assert _rows(blocked, cols) == _rows(plain, cols)
    assert plain.count() == 5


def test_closed_form_recurrence_across_sub_blocks_and_blocks(spark):
    """Series of ~5,300 bars: several 1024-row sub-blocks and, with tiny
    block_rows, several blocks per symbol; must equal the plain layout."""
    bars = line_bars(spark, "/root/testdata/sf0.1")
    names = ["ema", "macd", "atr"]
    cols = ["symbol", "ts"] + [c for n in names for c in output_columns(n)]
    plain = with_indicators(bars, names, blocked=False)
    blocked = with_indicators(bars, names, block_rows=16)
    assert _rows(blocked, cols, 5) == _rows(plain, cols, 5)


def _hourly(spark, hours=400):
    """Hourly bars of two symbols with null keys among them and a column of the user's own."""
    return spark.range(hours * 2).select(
        F.when(F.col("id") % 97 == 5, None).otherwise(F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("symbol"),
        F.when(F.col("id") % 89 == 7, None).otherwise(
            F.timestamp_seconds(1_700_000_000 + 3600 * F.floor(F.col("id") / 2))).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 13 + 10.0).alias("open"), (F.col("id") % 13 + 12.0).alias("high"),
        (F.col("id") % 13 + F.when(F.col("id") % 120 < 4, 9.0).otherwise(12.0)).alias("low"), (F.col("id") % 13 + 11.0).alias("close"),
        (F.col("id") % 7 + 1).cast("bigint").alias("volume"), F.col("id").alias("_src"))


def test_null_keys_day_anchor_and_own_columns_do_not_depend_on_blocks(spark):
    bars = _hourly(spark)
    args = {"params": {"vwap": {"anchor": "day"}}}
    plain = with_indicators(bars, ["vwap", "sma", "adl", "obv"], blocked=False, **args)
    blocked = with_indicators(bars, ["vwap", "sma", "adl", "obv"], block_rows=16, **args)
    assert lay_out(bars, halo=10, block_rows=16).blocked
    cols = ["symbol", "ts", "VWAP", "SMA_10", "ADL", "OBV", "_src"]
    assert _rows(blocked, cols) == _rows(plain, cols)
    assert plain.count() == bars.where("symbol is not null and ts is not null").count()


def test_blocks_are_bounded_on_clustered_times_and_hot_values(spark):
    """A burst after a long silence, and a value that most rows share, are cut like any other rows."""
    burst = spark.range(5001).select(F.lit("A").alias("symbol"), F.when(F.col("id") == 0, 0).otherwise(10 ** 9 + F.col("id"))
                                     .cast("double").alias("v"))
    even = spark.range(5000).select(F.lit("B").alias("symbol"), (F.col("id") * 1000.0).alias("v"))
    hot = spark.range(5000).select(F.lit("C").alias("symbol"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    laid = lay_out(burst.union(even).union(hot), ts="v", halo=10, block_rows=64)
    assert laid.blocked
    sizes = laid.df.groupBy("symbol", "_blk").agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own"),
                                                  F.min("_rn").alias("low"), F.max("_rn").alias("high")).collect()
    assert max(r.n for r in sizes) <= 64 + 10 and max(r.own for r in sizes) == 64
    assert all(r.high - r.low + 1 == r.n for r in sizes)
    assert laid.blocks.count() == len(sizes) == 79 * 3
    own = laid.df.where("_own")
    assert own.count() == 15001 and own.select("symbol", "_rn").distinct().count() == 15001
    order = own.select("symbol", "_rn", "v").collect()
    for s in "ABC":
        v = [r.v for r in sorted((r for r in order if r.symbol == s), key=lambda r: r["_rn"])]
        assert v == sorted(v)
