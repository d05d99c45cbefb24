"""Registered queries for the shared kernels, the suite and custom indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..operators.custom import example_customs
from ..operators.indicators import SUITE, output_columns, with_indicators
from ..sources.tables import LINE_BARS_SQL, event_bars, line_bars
from . import catalog_indicators as CI
from .catalog_indicators import REC_DIGITS, spark_round
from .sqlkit import P, cum, full, numbered, rnd, rows, tdiv

BAR_NUM = ["open", "high", "low", "close"]


def _bars_query(kind):
    def run(spark, sf_dir):
        b = (line_bars(spark, sf_dir, keep=False) if kind == "line"
             else event_bars(spark, sf_dir, keep=False))
        return b.select("symbol", "ts", *[spark_round(c).alias(c) for c in BAR_NUM], "volume")
    return run


def _bars_sql(kind):
    return (numbered(kind) + "\nSELECT symbol, ts, " +
            ", ".join(f"{rnd(c)} AS {c}" for c in BAR_NUM) + ", volume FROM s")


def _rounded(df, keep=("symbol", "ts"), digits=6):
    return df.select(*keep, *[spark_round(c, digits).alias(c) for c in df.columns
                              if c not in keep])


def q_lag_lead(spark, sf_dir):
    out = series.lag_lead(line_bars(spark, sf_dir), "close", lags=(1, 5), leads=(1,))
    return _rounded(out.select("symbol", "ts", "close_lag_1", "close_lag_5", "close_lead_1",
                               "close_diff", "close_pct_change"))


SQL_LAG_LEAD = numbered() + f"""
SELECT symbol, ts, {rnd(f'lag(close, 1) OVER ({P})')} AS close_lag_1,
       {rnd(f'lag(close, 5) OVER ({P})')} AS close_lag_5,
       {rnd(f'lead(close, 1) OVER ({P})')} AS close_lead_1,
       {rnd(f'close - lag(close, 1) OVER ({P})')} AS close_diff,
       {rnd(tdiv('close', f'lag(close, 1) OVER ({P})') + ' - 1.0')} AS close_pct_change
FROM s"""


def _q_rolling(full_):
    def run(spark, sf_dir):
        out = series.rolling_stats(event_bars(spark, sf_dir), "close", 5, full=full_)
        tag = "full" if full_ else "partial"
        return _rounded(out.select("symbol", "ts", *[f"close_{k}_{tag}" for k in
                                                     ("min", "max", "mean", "sum", "std")]))
    return run


def _sql_rolling(full_):
    tag = "full" if full_ else "partial"
    parts = []
    for k, agg in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sum", "sum"),
                   ("std", "stddev_samp")):
        e = full(agg, "close", 5) if full_ else f"{agg}(close) {rows(5)}"
        if k == "std" and not full_:
            e = f"coalesce({e}, 0.0)"
        parts.append(f"{rnd(e)} AS close_{k}_{tag}")
    return numbered("event") + "\nSELECT symbol, ts, " + ", ".join(parts) + " FROM s"


def q_cumulative(spark, sf_dir):
    out = series.cumulative_stats(line_bars(spark, sf_dir), "volume")
    return _rounded(out.select("symbol", "ts", "volume_cumsum", "volume_cummean",
                               "volume_cummax", "volume_cummin"))


SQL_CUMULATIVE = numbered() + f"""
SELECT symbol, ts, {rnd(f'sum(CAST(volume AS DOUBLE)) {cum()}')} AS volume_cumsum,
       {rnd(f'avg(CAST(volume AS DOUBLE)) {cum()}')} AS volume_cummean,
       {rnd(f'max(CAST(volume AS DOUBLE)) {cum()}')} AS volume_cummax,
       {rnd(f'min(CAST(volume AS DOUBLE)) {cum()}')} AS volume_cummin
FROM s"""


def q_running_extreme(spark, sf_dir):
    out = series.running_extreme(line_bars(spark, sf_dir), "close")
    return _rounded(out.select("symbol", "ts", "running_peak", "running_trough", "drawdown"))


SQL_RUNNING_EXTREME = numbered() + f""",
a AS (SELECT symbol, ts, close, max(close) {cum()} AS pk, min(close) {cum()} AS tr FROM s)
SELECT symbol, ts, {rnd('pk')} AS running_peak, {rnd('tr')} AS running_trough,
       {rnd(tdiv('pk - close', 'pk'))} AS drawdown FROM a"""


def _thin(df):
    # a bar with fewer than 30 units traded has no reliable price: null it
    return df.withColumn("px", F.when(F.col("volume") >= 30, F.col("close")))


def _q_fill(method):
    def run(spark, sf_dir):
        out = series.fill(_thin(line_bars(spark, sf_dir)), "px", method, out="px_filled")
        return _rounded(out.select("symbol", "ts", "px", "px_filled"))
    return run


def _sql_fill(method):
    base = numbered() + ",\nt AS (SELECT *, CASE WHEN volume >= 30 THEN close END AS px FROM s)"
    if method == "ffill":
        e = f"last_value(px IGNORE NULLS) {cum()}"
    elif method == "bfill":
        e = (f"first_value(px IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW "
             f"AND UNBOUNDED FOLLOWING)")
    else:
        base += f""",
u AS (SELECT *, last_value(CASE WHEN px IS NOT NULL THEN rn END IGNORE NULLS) {cum()} AS pr,
             last_value(px IGNORE NULLS) {cum()} AS pv,
             first_value(CASE WHEN px IS NOT NULL THEN rn END IGNORE NULLS) OVER ({P}
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
             first_value(px IGNORE NULLS) OVER ({P}
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM t)"""
        e = ("CASE WHEN px IS NOT NULL THEN px WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv "
             "ELSE pv + (nv - pv) * (rn - pr) / (nr - pr) END")
        return base + f"\nSELECT symbol, ts, {rnd('px')} AS px, {rnd(e)} AS px_filled FROM u"
    return base + f"\nSELECT symbol, ts, {rnd('px')} AS px, {rnd(e)} AS px_filled FROM t"


def q_ewm(spark, sf_dir):
    out = with_indicators(event_bars(spark, sf_dir), ["ema"], params={"ema": {"window": 20}})
    return out.select("symbol", "ts", spark_round("EMA_20", REC_DIGITS).alias("EMA_20"))


def _event_sql(sql):
    return sql.replace(LINE_BARS_SQL, CI.BARS_EVENT)


def q_wilder(spark, sf_dir):
    out = with_indicators(event_bars(spark, sf_dir), ["atr"])
    return out.select("symbol", "ts", spark_round("ATR", REC_DIGITS).alias("ATR"))


def q_fold(spark, sf_dir):
    out = with_indicators(event_bars(spark, sf_dir), ["psar"])
    return out.select("symbol", "ts", spark_round("PSAR", REC_DIGITS).alias("PSAR"))


def q_suite(spark, sf_dir):
    out = with_indicators(line_bars(spark, sf_dir), SUITE)
    cols = [c for n in SUITE for c in output_columns(n)]
    rec = {c for n in ("trix", "ema", "macd", "adx", "psar", "chandelier_exit", "keltner",
                       "volume_oscillator") for c in output_columns(n)}
    return out.select("symbol", "ts", *[spark_round(c, REC_DIGITS if c in rec else 6).alias(c)
                                         for c in cols])


def sql_suite():
    sqls = {"sample_custom": CI.sql_sample_custom(), "another_custom": CI.sql_another_custom(),
            "stochastic_oscillator": CI.sql_stochastic(), "rsi": CI.sql_rsi(),
            "williams_r": CI.sql_williams(), "roc": CI.sql_roc(), "trix": CI.sql_trix(),
            "sma": CI.sql_sma(), "ema": CI.sql_ema(), "macd": CI.sql_macd(), "adx": CI.sql_adx(),
            "ichimoku": CI.sql_ichimoku(), "psar": CI.sql_psar(), "bollinger": CI.sql_bollinger(),
            "rolling_std": CI.sql_rolling_std(), "historical_volatility": CI.sql_hv(),
            "chandelier_exit": CI.sql_chandelier(), "keltner": CI.sql_keltner(),
            "ma_envelope": CI.sql_envelope(), "mfi": CI.sql_mfi(), "obv": CI.sql_obv(),
            "vwap": CI.sql_vwap(), "adl": CI.sql_adl(), "cmf": CI.sql_cmf(),
            "volume_oscillator": CI.sql_volume_osc()}
    parts = [f"({sqls[n]}) q{i}" for i, n in enumerate(SUITE)]
    return "SELECT * FROM " + " JOIN ".join(
        p if i == 0 else f"{p} USING (symbol, ts)" for i, p in enumerate(parts))


def q_custom(spark, sf_dir):
    out = with_indicators(line_bars(spark, sf_dir), [], custom=example_customs(5, 10))
    return _rounded(out.select("symbol", "ts", "Sample_Custom_Indicator",
                               "Another_Custom_Indicator"))


SQL_CUSTOM = numbered() + f"""
SELECT symbol, ts, {rnd(full('avg', 'close', 5))} AS Sample_Custom_Indicator,
       {rnd(full('stddev_samp', 'close', 10))} AS Another_Custom_Indicator FROM s"""


def catalog():
    ev = CI.BARS_EVENT
    return {
        "bars_from_ticks": (_bars_query("line"), _bars_sql("line")),
        "bars_from_events": (_bars_query("event"), _bars_sql("event")),
        "lag_lead": (q_lag_lead, SQL_LAG_LEAD),
        "rolling_partial": (_q_rolling(False), _sql_rolling(False)),
        "rolling_full": (_q_rolling(True), _sql_rolling(True)),
        "cumulative": (q_cumulative, SQL_CUMULATIVE),
        "running_extreme": (q_running_extreme, SQL_RUNNING_EXTREME),
        "ffill": (_q_fill("ffill"), _sql_fill("ffill")),
        "bfill": (_q_fill("bfill"), _sql_fill("bfill")),
        "interpolate": (_q_fill("interpolate"), _sql_fill("interpolate")),
        "ewm": (q_ewm, CI.sql_ema(20).replace(LINE_BARS_SQL, ev)),
        "wilder": (q_wilder, CI.sql_atr().replace(LINE_BARS_SQL, ev)),
        "path_dependent_fold": (q_fold, CI.sql_psar().replace(LINE_BARS_SQL, ev)),
        "indicator_suite": (q_suite, sql_suite()),
        "custom_indicator": (q_custom, SQL_CUSTOM),
        "custom_indicators_many": (q_custom, SQL_CUSTOM),
    }
