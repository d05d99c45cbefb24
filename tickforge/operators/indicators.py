"""Technical indicators for all symbols in one plan.

Each indicator is a function ``(df, carries, sym, **params) -> df`` over a
laid-out frame (see :mod:`tickforge.plans.layout`); it appends its columns
and, when it needs a running total across blocks, registers a carry spec.
:func:`with_indicators` lays the bars out once with the largest look-back of
the chosen indicators, applies them in order and finishes the carries, so the
whole suite shares one exchange on ``(symbol, _blk)`` and one sort.

Null / inf handling follows each indicator's own rule (never a global fill);
every ratio uses ``try_divide`` or a guard because ANSI mode raises on x/0.
"""

from __future__ import annotations

import functools
import operator
import inspect
import math
import types
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import (apply_recurrences, c, ema_lookback, ema_spec, lag, lead,
                                 local_cumsum, rolling_max, rolling_mean, rolling_min,
                                 rolling_std, rolling_sum, wilder_lookback, wilder_spec)
from ..plans.layout import (BLK, LAYOUT_COLS, ORD, OWN, RN, add_carry, lay_out, own_only,
                            series_sizes, series_window)
from ..schema import SYM, TS, require_columns, require_window

HLC = ("high", "low", "close")


# ------------------------------------------------------------------ staging
# Indicators with recurrences (EMA / Wilder) are generators: they hand their
# recurrence specs to the driver with ``df = yield from need(df, specs)``
# and resume with the outputs attached. The suite driver collects the specs
# of every indicator at the same dependency level and evaluates them in one
# set of radix passes (one window operator per pass for all of them).
def need(df, specs):
    return (yield (df, specs))


def run_staged(df, calls, sym, gaps=False, blocked=False):
    """Apply ``calls`` = [(fn, kwargs)], recurrences in lock-step.

    Staged (recurrent) indicators run first, while rows are still narrow:
    every window operator copies whole rows, so the outputs of the one-pass
    indicators are only added after the recurrence passes."""
    pending, plain = [], []
    for fn, kw in calls:
        base = fn.func if isinstance(fn, functools.partial) else fn
        if not inspect.isgeneratorfunction(base):
            plain.append((fn, kw))
            continue
        res = fn(df, **kw)
        if isinstance(res, types.GeneratorType):
            try:
                df, specs = next(res)
                pending.append((res, specs))
            except StopIteration as stop:
                df = stop.value
        else:
            df = res
    df = _drain(df, pending, sym, gaps, blocked)
    for fn, kw in plain:
        df = fn(df, **kw)
    return df


def _drain(df, pending, sym, gaps, blocked):
    while pending:
        df = apply_recurrences(df, [sp for _, specs in pending for sp in specs], sym, gaps, blocked)
        nxt = []
        for gen, _ in pending:
            try:
                df, specs = gen.send(df)
                nxt.append((gen, specs))
            except StopIteration as stop:
                df = stop.value
        pending = nxt
    return df


def run_one(fn, df, *args, sym=SYM, **kw):
    """Run one (possibly staged) indicator on its own."""
    return run_staged(df, [(lambda d: fn(d, *args, sym=sym, **kw), {})], sym)


# ----------------------------------------------------------------- momentum
def stochastic_oscillator(df, carries, sym=SYM, window=14):
    require_window(window)
    require_columns(df, HLC, "stochastic_oscillator")
    ll = rolling_min("low", window, sym)
    hh = rolling_max("high", window, sym)
    den = hh - ll
    den = F.when(den == 0, F.lit(1.0)).otherwise(den)
    df = df.withColumn("Stochastic", F.lit(100.0) * (F.col("close") - ll) / den)
    return df.withColumn("Stochastic_Signal", rolling_mean("Stochastic", 3, sym))


def _gain_loss(sym):
    delta = F.col("close") - lag("close", 1, sym)
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    return gain, loss


def rsi(df, carries, sym=SYM, window=14, calculation_type="default", out="RSI"):
    """Simple-mean RSI. default: partial windows; custom: full windows then 0;
    strict: full windows, no fill (null before n and on 0/0)."""
    require_window(window)
    require_columns(df, ["close"], "rsi")
    gain, loss = _gain_loss(sym)
    df = df.withColumn("_gain", gain).withColumn("_loss", loss)
    full = calculation_type in ("custom", "strict")
    if calculation_type not in ("default", "custom", "strict"):
        raise ValueError(f"unknown RSI calculation_type {calculation_type!r}")
    ag = rolling_mean("_gain", window, sym, full=full)
    al = rolling_mean("_loss", window, sym, full=full)
    df = df.withColumn("_ag", ag).withColumn("_al", al)
    ag, al = F.col("_ag"), F.col("_al")
    val = (F.when(al == 0, F.when(ag > 0, F.lit(100.0)))
           .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ag / al)))
    if calculation_type != "strict":
        val = F.coalesce(val, F.lit(0.0))
    return df.withColumn(out, val).drop("_gain", "_loss", "_ag", "_al")


def rsi_custom(df, carries, sym=SYM, window=14, out="RSI"):
    return rsi(df, carries, sym, window, "custom", out)


def rsi_strict(df, carries, sym=SYM, window=14, out="RSI"):
    return rsi(df, carries, sym, window, "strict", out)


def williams_r(df, carries, sym=SYM, window=14):
    require_window(window)
    require_columns(df, HLC, "williams_r")
    hh = rolling_max("high", window, sym)
    ll = rolling_min("low", window, sym)
    den = hh - ll
    den = F.when(den == 0, F.lit(1.0)).otherwise(den)
    val = F.lit(-100.0) * (hh - F.col("close")) / den
    return df.withColumn("Williams_R", F.coalesce(val, F.lit(0.0)))


def roc(df, carries, sym=SYM, window=10):
    require_window(window)
    require_columns(df, ["close"], "roc")
    prev = lag("close", window, sym)
    val = F.when(prev.isNull(), F.lit(0.0)).otherwise(
        F.lit(100.0) * F.try_divide(F.col("close") - prev, prev))
    return df.withColumn("ROC", val)


def trix(df, carries, sym=SYM, span=15, signal_line_span=9):
    require_window(span, "span")
    require_window(signal_line_span, "signal_line_span")
    require_columns(df, ["close"], "trix")
    df = yield from need(df, [ema_spec("_trix_e1", "close", span)])
    df = yield from need(df, [ema_spec("_trix_e2", "_trix_e1", span)])
    df = yield from need(df, [ema_spec("_trix_e3", "_trix_e2", span)])
    e3 = F.col("_trix_e3")
    df = df.withColumn("TRIX", F.lit(100.0) * (F.try_divide(e3, lag(e3, 1, sym)) - F.lit(1.0)))
    # the signal starts at the first non-null TRIX (row 2)
    df = yield from need(df, [ema_spec("TRIX_signal", "TRIX", signal_line_span, seed_rn=2)])
    return df.drop("_trix_e1", "_trix_e2", "_trix_e3")


# -------------------------------------------------------------------- trend
def sma(df, carries, sym=SYM, window=10, column="close"):
    require_window(window)
    require_columns(df, [column], "sma")
    return df.withColumn(f"SMA_{window}", rolling_mean(column, window, sym, full=True))


def ema(df, carries, sym=SYM, window=10, column="close"):
    require_window(window)
    require_columns(df, [column], "ema")
    return (yield from need(df, [ema_spec(f"EMA_{window}", column, window)]))


def moving_average(df, carries, sym=SYM, window=10, column="close", ma_type="SMA"):
    kind = str(ma_type).lower()
    if kind == "sma":
        return sma(df, carries, sym, window, column)
    if kind == "ema":
        return (yield from ema(df, carries, sym, window, column))
    raise ValueError(f"ma_type must be SMA or EMA, got {ma_type!r}")


def macd(df, carries, sym=SYM, fast=12, slow=26, signal=9):
    for n, name in ((fast, "fast"), (slow, "slow"), (signal, "signal")):
        require_window(n, name)
    require_columns(df, ["close"], "macd")
    df = yield from need(df, [ema_spec("_macd_fast", "close", fast),
                              ema_spec("_macd_slow", "close", slow)])
    df = df.withColumn("MACD", F.col("_macd_fast") - F.col("_macd_slow"))
    df = yield from need(df, [ema_spec("MACD_Signal", "MACD", signal)])
    df = df.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))
    df = yield from need(df, [ema_spec("MACD_Hist_Signal", "MACD_Hist", signal)])
    return df.drop("_macd_fast", "_macd_slow")


def _true_range(sym):
    pc = lag("close", 1, sym)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc),
                    F.abs(F.col("low") - pc))
    return F.when(pc.isNotNull(), tr)


def adx(df, carries, sym=SYM, window=14):
    """Wilder ADX: +DM/-DM and TR from row 2, Wilder sums seeded at row n+1,
    DX, then ADX seeded at row 2n with the mean of the first n DX values."""
    n = require_window(window)
    require_columns(df, HLC, "adx")
    up = F.col("high") - lag("high", 1, sym)
    down = lag("low", 1, sym) - F.col("low")
    later = F.col(RN) > 1
    df = df.withColumns({
        "_adx_tr": _true_range(sym),
        "_adx_pdm": F.when(later, F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))),
        "_adx_mdm": F.when(later, F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))})
    seed = n + 1
    df = df.withColumns({"_adx_s_tr": rolling_sum("_adx_tr", n, sym, full=True),
                         "_adx_s_p": rolling_sum("_adx_pdm", n, sym, full=True),
                         "_adx_s_m": rolling_sum("_adx_mdm", n, sym, full=True)})
    df = yield from need(df, [
        wilder_spec("_adx_w_tr", "_adx_tr", n, seed, "_adx_s_tr", scale_by_n=False),
        wilder_spec("_adx_w_p", "_adx_pdm", n, seed, "_adx_s_p", scale_by_n=False),
        wilder_spec("_adx_w_m", "_adx_mdm", n, seed, "_adx_s_m", scale_by_n=False)])
    pdi = F.lit(100.0) * F.try_divide(F.col("_adx_w_p"), F.col("_adx_w_tr"))
    mdi = F.lit(100.0) * F.try_divide(F.col("_adx_w_m"), F.col("_adx_w_tr"))
    dx = F.coalesce(F.lit(100.0) * F.try_divide(F.abs(pdi - mdi), pdi + mdi), F.lit(0.0))
    df = df.withColumn("_adx_dx", F.when(F.col(RN) >= seed, dx))
    df = df.withColumn("_adx_dx_seed", rolling_mean("_adx_dx", n, sym, full=True))
    df = yield from need(df, [wilder_spec("ADX", "_adx_dx", n, 2 * n, "_adx_dx_seed")])
    return df.drop(*[c for c in df.columns if c.startswith("_adx_")])


def ichimoku(df, carries, sym=SYM, windows=(9, 26, 52)):
    """Conversion, base, leading spans A/B (shifted forward by the middle
    window). The lagging span looks ahead; it is added after the blocks are
    finished (see POST_STEPS) and must not be used as a feature."""
    if not (isinstance(windows, tuple) and len(windows) == 3):
        raise ValueError(f"ichimoku takes three window lengths, got {windows!r}")
    n1, n2, n3 = (require_window(w) for w in windows)
    require_columns(df, HLC, "ichimoku")

    def line(n):
        return (rolling_max("high", n, sym, full=True) + rolling_min("low", n, sym, full=True)) / 2

    df = (df.withColumn("Ichimoku_Conversion_Line", line(n1))
          .withColumn("Ichimoku_Base_Line", line(n2))
          .withColumn("_span_b", line(n3)))
    df = (df.withColumn("Ichimoku_Leading_Span_A",
                        lag((F.col("Ichimoku_Conversion_Line") + F.col("Ichimoku_Base_Line")) / 2,
                            n2, sym))
          .withColumn("Ichimoku_Leading_Span_B", lag("_span_b", n2, sym)))
    return df.drop("_span_b")


def ichimoku_lagging_span(finished: DataFrame, base: DataFrame, blocked: bool, sym=SYM,
                          windows=(9, 26, 52)):
    """close shifted back by the middle window (``shift(-n)``).

    With one block per symbol it is a plain ``lead`` inside the window the
    suite already sorted. Across blocks the next rows live in another block,
    so it is a keyed join on (symbol, row number) against the laid-out *base*
    bars (not the finished frame, whose plan would be evaluated twice)."""
    n2 = windows[1]
    if not blocked:
        return finished.withColumn("Ichimoku_Lagging_Span", lead("close", n2, sym))
    ahead = (base.where(F.col(OWN))
             .select(sym, (F.col(RN) - n2).alias(RN), F.col("close").alias("Ichimoku_Lagging_Span")))
    return finished.join(ahead, [sym, RN], "left")


# --------------------------------------------------------------- volatility
def bollinger(df, carries, sym=SYM, window=10, std_multiplier=2):
    require_window(window)
    require_columns(df, ["close"], "bollinger")
    mean = rolling_mean("close", window, sym)
    std = F.coalesce(rolling_std("close", window, sym), F.lit(0.0))
    df = df.withColumn("_m", mean).withColumn("_s", std)
    return (df.withColumn("Bollinger_High", F.col("_m") + F.col("_s") * std_multiplier)
            .withColumn("Bollinger_Low", F.col("_m") - F.col("_s") * std_multiplier)
            .withColumn("Bollinger_Mid", F.col("_m")).drop("_m", "_s"))


def rolling_std_ind(df, carries, sym=SYM, window=20):
    require_window(window)
    require_columns(df, ["close"], "rolling_std")
    return df.withColumn("Standard_Deviation",
                         F.coalesce(rolling_std("close", window, sym), F.lit(0.0)))


def historical_volatility(df, carries, sym=SYM, window=20):
    require_window(window)
    require_columns(df, ["close"], "historical_volatility")
    ratio = F.try_divide(F.col("close"), lag("close", 1, sym))
    lr = F.when(ratio > 0, F.ln(ratio))
    df = df.withColumn("_lr", F.coalesce(lr, F.lit(0.0)))
    return (df.withColumn("Historical_Volatility",
                          rolling_std("_lr", window, sym) * F.lit(math.sqrt(window)))
            .drop("_lr"))


def _atr(df, sym, n, out):
    """Wilder ATR: TR from row 2; seed at row n+1 = mean of the first n TR;
    rows before the seed are 0 (the reference fills them)."""
    tr, seed = f"{out}__tr", f"{out}__seed"
    df = df.withColumn(tr, _true_range(sym))
    df = df.withColumn(seed, rolling_mean(tr, n, sym, full=True))
    df = yield from need(df, [wilder_spec(out, tr, n, n + 1, seed)])
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(0.0))).drop(tr, seed)


def atr(df, carries, sym=SYM, window=14):
    require_window(window)
    require_columns(df, HLC, "atr")
    return (yield from _atr(df, sym, window, "ATR"))


def chandelier_exit(df, carries, sym=SYM, window=22, multiplier=3):
    require_window(window)
    require_columns(df, HLC, "chandelier_exit")
    df = yield from _atr(df, sym, window, "_atr_ce")
    return (df.withColumn("Chandelier_Exit_Long",
                          rolling_max("high", window, sym) - F.lit(multiplier) * F.col("_atr_ce"))
            .drop("_atr_ce"))


def keltner(df, carries, sym=SYM, window=20, multiplier=2):
    require_window(window)
    require_columns(df, HLC, "keltner")
    df = yield from _atr(df, sym, window, "_atr_kc")
    df = df.withColumn("Keltner_Channel_Mid", rolling_mean("close", window, sym))
    return (df.withColumn("Keltner_Channel_High",
                          F.col("Keltner_Channel_Mid") + F.lit(multiplier) * F.col("_atr_kc"))
            .withColumn("Keltner_Channel_Low",
                        F.col("Keltner_Channel_Mid") - F.lit(multiplier) * F.col("_atr_kc"))
            .drop("_atr_kc"))


def ma_envelope(df, carries, sym=SYM, window=10, percentage=0.025):
    require_window(window)
    if not isinstance(percentage, float) or not (0 <= percentage <= 1):
        raise ValueError(f"percentage lies in [0, 1], got {percentage!r}")
    require_columns(df, ["close"], "ma_envelope")
    df = df.withColumn("_sma", rolling_mean("close", window, sym))
    return (df.withColumn("MAE_Upper", F.col("_sma") * (1 + percentage))
            .withColumn("MAE_Lower", F.col("_sma") * (1 - percentage)).drop("_sma"))


# ------------------------------------------------------------------- volume
def mfi(df, carries, sym=SYM, window=14):
    require_window(window)
    require_columns(df, HLC + ("volume",), "mfi")
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = tp * F.col("volume")
    pc = lag("close", 1, sym)
    df = (df.withColumn("_pos", F.when(F.col("close") > pc, flow).otherwise(F.lit(0.0)))
          .withColumn("_neg", F.when(F.col("close") < pc, flow).otherwise(F.lit(0.0))))
    pos = rolling_sum("_pos", window, sym)
    neg = rolling_sum("_neg", window, sym)
    neg = F.when(neg == 0, F.lit(1.0)).otherwise(neg)
    val = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + pos / neg)
    return df.withColumn("MFI", F.coalesce(val, F.lit(0.0))).drop("_pos", "_neg")


def obv(df, carries, sym=SYM):
    require_columns(df, ["close", "volume"], "obv")
    step = F.col("volume") * F.coalesce(F.signum(F.col("close") - lag("close", 1, sym)),
                                        F.lit(0.0))
    df = df.withColumn("_obv_l", local_cumsum(step, sym))
    carries["OBV"] = ("_obv_l", "sum")
    return df


def vwap(df, carries, sym=SYM, price_type="typical", adjust_for_splits=False, anchor="symbol"):
    """Cumulative volume-weighted price from the first bar of the symbol
    (``anchor="symbol"``, the reference) or of each calendar day
    (``anchor="day"``, sessions of intraday bars; a day is bounded)."""
    require_columns(df, HLC + ("volume",), "vwap")
    if price_type == "typical":
        px = (F.col("high") + F.col("low") + F.col("close")) / 3
    elif price_type == "weighted_close":
        px = (F.col("high") + F.col("low") + 2 * F.col("close")) / 4
    else:
        raise ValueError(f"unknown price_type {price_type!r}")
    vol = F.col("volume").cast("double")
    if adjust_for_splits:
        require_columns(df, ["split_coefficient"], "vwap")
        vol = F.try_divide(vol, F.col("split_coefficient"))
    if anchor == "day":
        day = Window.partitionBy(sym, BLK, F.to_date(ORD)).orderBy(RN).rowsBetween(
            Window.unboundedPreceding, 0)
        df = (df.withColumn("_pv_l", F.sum(own_only(px * vol)).over(day))
              .withColumn("_v_l", F.sum(own_only(vol)).over(day)))
    elif anchor == "symbol":
        df = (df.withColumn("_pv_l", local_cumsum(px * vol, sym))
              .withColumn("_v_l", local_cumsum(vol, sym)))
    else:
        raise ValueError(f"unknown vwap anchor {anchor!r}")
    kind = "sum" if anchor == "symbol" else "day_sum"
    carries["_pv"] = ("_pv_l", kind)
    carries["_v"] = ("_v_l", kind)
    carries.setdefault("__post__", []).append(
        ("VWAP", F.try_divide(F.col("_pv"), F.col("_v")), ["_pv", "_v"]))
    return df


def _clv(range_col):
    num = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    return F.when(num == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(num, range_col), F.lit(0.0)))


def adl(df, carries, sym=SYM):
    """Cumulative CLV x volume; a zero range borrows the previous non-zero
    range of the same symbol, also from an earlier block."""
    require_columns(df, HLC + ("volume",), "adl")
    own = series_window(sym).rowsBetween(Window.unboundedPreceding, 0)
    spread = F.col("high") - F.col("low")
    df = df.withColumn("_adl_r", F.last(own_only(F.when(spread != 0, spread)), ignorenulls=True).over(own))
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) * F.col("volume")
    waits = F.when(F.col("_adl_r").isNull(), flow).otherwise(F.lit(0.0))
    df = (df.withColumn("_adl_l", local_cumsum(_clv(F.col("_adl_r")) * F.col("volume"), sym))
          .withColumn("_adl_w", local_cumsum(waits, sym)))
    carries["ADL"] = (("_adl_l", "_adl_w", "_adl_r"), "sum_over_last")
    return df


def cmf(df, carries, sym=SYM, window=14):
    require_window(window)
    require_columns(df, HLC + ("volume",), "cmf")
    num = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    clv = F.coalesce(F.try_divide(num, F.col("high") - F.col("low")), F.lit(0.0))
    df = df.withColumn("_mfv", clv * F.col("volume"))
    val = F.try_divide(rolling_sum("_mfv", window, sym),
                       rolling_sum(F.col("volume").cast("double"), window, sym))
    return df.withColumn("CMF", val).drop("_mfv")


def volume_oscillator(df, carries, sym=SYM, short_window=12, long_window=26):
    require_window(short_window)
    require_window(long_window)
    if short_window >= long_window:
        raise ValueError("short_window must be less than long_window")
    require_columns(df, ["volume"], "volume_oscillator")
    v = F.col("volume").cast("double")
    df = yield from need(df, [ema_spec("_vo_s", v, short_window),
                              ema_spec("_vo_l", v, long_window)])
    return df.withColumn("Volume_Oscillator", F.col("_vo_s") - F.col("_vo_l")).drop("_vo_s",
                                                                                     "_vo_l")


# ------------------------------------------------------------------- custom
def sample_custom(df, carries, sym=SYM, window_size=10, name="Sample_Custom_Indicator"):
    require_window(window_size)
    return df.withColumn(name, rolling_mean("close", window_size, sym, full=True))


def another_custom(df, carries, sym=SYM, window_size=5, name="Another_Custom_Indicator"):
    require_window(window_size)
    return df.withColumn(name, rolling_std("close", window_size, sym, full=True))


# ----------------------------------------------------------------- registry
@dataclass(frozen=True)
class Indicator:
    fn: Callable
    lookback: Callable[..., int]
    columns: tuple
    defaults: dict


def _p(params, key, default):
    return params.get(key, default)


REGISTRY: dict[str, Indicator] = {
    "stochastic_oscillator": Indicator(stochastic_oscillator,
                                       lambda p: _p(p, "window", 14) + 3,
                                       ("Stochastic", "Stochastic_Signal"), {}),
    "rsi": Indicator(rsi, lambda p: _p(p, "window", 14) + 1, ("RSI",), {}),
    "rsi_custom": Indicator(rsi_custom, lambda p: _p(p, "window", 14) + 1, ("RSI",), {}),
    "rsi_strict": Indicator(rsi_strict, lambda p: _p(p, "window", 14) + 1, ("RSI",), {}),
    "williams_r": Indicator(williams_r, lambda p: _p(p, "window", 14), ("Williams_R",), {}),
    "roc": Indicator(roc, lambda p: _p(p, "window", 10) + 1, ("ROC",), {}),
    "trix": Indicator(trix, lambda p: 3 * ema_lookback(_p(p, "span", 15))
                      + ema_lookback(_p(p, "signal_line_span", 9)) + 2,
                      ("TRIX", "TRIX_signal"), {}),
    "sma": Indicator(sma, lambda p: _p(p, "window", 10), ("SMA_{window}",), {"window": 10}),
    "ema": Indicator(ema, lambda p: ema_lookback(_p(p, "window", 10)), ("EMA_{window}",),
                     {"window": 10}),
    "macd": Indicator(macd, lambda p: ema_lookback(_p(p, "slow", 26))
                      + 2 * ema_lookback(_p(p, "signal", 9)) + 1,
                      ("MACD", "MACD_Signal", "MACD_Hist", "MACD_Hist_Signal"), {}),
    "adx": Indicator(adx, lambda p: 2 * wilder_lookback(_p(p, "window", 14)) + 2, ("ADX",), {}),
    "ichimoku": Indicator(ichimoku, lambda p: max(_p(p, "windows", (9, 26, 52)))
                          + _p(p, "windows", (9, 26, 52))[1],
                          ("Ichimoku_Conversion_Line", "Ichimoku_Base_Line",
                           "Ichimoku_Leading_Span_A", "Ichimoku_Leading_Span_B",
                           "Ichimoku_Lagging_Span"), {}),
    "bollinger": Indicator(bollinger, lambda p: _p(p, "window", 10),
                           ("Bollinger_High", "Bollinger_Low", "Bollinger_Mid"), {}),
    "rolling_std": Indicator(rolling_std_ind, lambda p: _p(p, "window", 20),
                             ("Standard_Deviation",), {}),
    "historical_volatility": Indicator(historical_volatility,
                                       lambda p: _p(p, "window", 20) + 1,
                                       ("Historical_Volatility",), {}),
    "atr": Indicator(atr, lambda p: wilder_lookback(_p(p, "window", 14)), ("ATR",), {}),
    "chandelier_exit": Indicator(chandelier_exit,
                                 lambda p: wilder_lookback(_p(p, "window", 22)),
                                 ("Chandelier_Exit_Long",), {}),
    "keltner": Indicator(keltner, lambda p: wilder_lookback(_p(p, "window", 20)),
                         ("Keltner_Channel_High", "Keltner_Channel_Low",
                          "Keltner_Channel_Mid"), {}),
    "ma_envelope": Indicator(ma_envelope, lambda p: _p(p, "window", 10),
                             ("MAE_Upper", "MAE_Lower"), {}),
    "mfi": Indicator(mfi, lambda p: _p(p, "window", 14) + 1, ("MFI",), {}),
    "obv": Indicator(obv, lambda p: 1, ("OBV",), {}),
    "vwap": Indicator(vwap, lambda p: 0, ("VWAP",), {}),
    "adl": Indicator(adl, lambda p: 1, ("ADL",), {}),
    "cmf": Indicator(cmf, lambda p: _p(p, "window", 14), ("CMF",), {}),
    "volume_oscillator": Indicator(volume_oscillator,
                                   lambda p: ema_lookback(_p(p, "long_window", 26)),
                                   ("Volume_Oscillator",), {}),
    "sample_custom": Indicator(sample_custom, lambda p: _p(p, "window_size", 10),
                               ("Sample_Custom_Indicator",), {}),
    "another_custom": Indicator(another_custom, lambda p: _p(p, "window_size", 5),
                                ("Another_Custom_Indicator",), {}),
}

# The 25 names a user can select for the suite, in the reference's order.
SUITE = ["sample_custom", "another_custom", "stochastic_oscillator", "rsi", "williams_r",
         "roc", "trix", "sma", "ema", "macd", "adx", "ichimoku", "psar", "bollinger",
         "rolling_std", "historical_volatility", "chandelier_exit", "keltner",
         "ma_envelope", "mfi", "obv", "vwap", "adl", "cmf", "volume_oscillator"]


def output_columns(name: str, params: dict | None = None) -> list[str]:
    if name == "psar":
        return ["PSAR"]
    ind = REGISTRY[name]
    p = {**ind.defaults, **(params or {})}
    return [col.format(**p) for col in ind.columns]


#: Indicators with exponential means, and the columns these run over (``ema`` can name another).
WEIGHTED = {"ema": "close", "macd": "close", "trix": "close", "ma_envelope": "close", "volume_oscillator": "volume"}


def _has_gaps(bars: DataFrame, names, params) -> bool:
    """Whether an input of an exponential mean holds a null: its weights then differ from row to row."""
    used = {params.get(n, {}).get("column", WEIGHTED[n]) for n in names if n in WEIGHTED} & set(bars.columns)
    nulls = [F.col(c).isNull() for c in sorted(used)]
    return bool(nulls) and not bars.where(functools.reduce(operator.or_, nulls)).select(F.lit(1)).isEmpty()


def with_indicators(bars: DataFrame, names=None, *, sym: str = SYM, ts: str = TS,
                    params: dict | None = None, blocked: bool = True,
                    keep_layout: bool = False, custom=None, **layout_kw) -> DataFrame:
    """Append the chosen indicators to a bar table of many symbols.

    ``params`` maps an indicator name to its keyword arguments. ``custom`` is
    a list of :class:`tickforge.operators.custom.CustomIndicator` applied
    after the built-ins. One layout (one exchange, one sort) serves them all.
    """
    from .fold import psar as psar_fold  # local import: grouped-map path

    names = list(SUITE if names is None else names)
    params = dict(params or {})
    variants = [n for n in names if n in ("rsi", "rsi_custom", "rsi_strict")]
    for n in variants[1:]:  # several in one table: RSI, then RSI_custom, RSI_strict
        params[n] = {"out": n.replace("rsi", "RSI"), **params.get(n, {})}
    custom = list(custom or [])
    unknown = [n for n in names if n != "psar" and n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown indicator(s) {unknown}")
    # asked of the bars as given, so that the fold below runs once
    gaps = _has_gaps(bars.where(F.col(sym).isNotNull() & F.col(ts).isNotNull()), names, params)
    if "psar" in names:
        if blocked and "largest" not in layout_kw:
            # size the layout on the raw bars: the fold output has the same rows
            layout_kw["largest"], layout_kw["total"] = series_sizes(bars, sym)
        bars = psar_fold(bars, sym=sym, ts=ts, **params.get("psar", {}))
    halo = max([REGISTRY[n].lookback(params.get(n, {})) for n in names if n != "psar"]
               + [ci.lookback for ci in custom] + [0])
    laid = lay_out(bars, sym, ts, halo=halo, blocked=blocked, **layout_kw)
    df = laid.df
    carries: dict = {}
    calls = [(functools.partial(REGISTRY[n].fn, carries=carries, sym=sym),
              params.get(n, {})) for n in names if n != "psar"]
    df = run_staged(df, calls, sym, gaps, laid.blocked)
    for ci in custom:
        df = ci.apply(df, sym)
    post = carries.pop("__post__", [])
    if carries:
        df = add_carry(laid.with_df(df), carries)
    else:
        df = df.where(F.col(OWN))
    drop = []
    for out, expr, tmp in post:
        df = df.withColumn(out, expr)
        drop += tmp
    if "ichimoku" in names:
        df = ichimoku_lagging_span(df, laid.df, laid.blocked, sym,
                                   params.get("ichimoku", {}).get("windows", (9, 26, 52)))
    drop += [col for col in df.columns
             if col.startswith("_") and col not in LAYOUT_COLS and col not in bars.columns]
    df = df.drop(*drop)
    if not keep_layout:
        df = df.drop(*LAYOUT_COLS)
    return df

