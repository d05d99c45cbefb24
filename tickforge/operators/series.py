"""Series kernels as user-facing operators (lag/lead, rolling, cumulative,
running extremes, fills, interpolation), each one laid-out plan per call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.layout import LAYOUT_COLS, OWN, RN, add_carry, lay_out
from ..schema import SYM, TS, require_columns, require_window


def run_series(bars: DataFrame, build, *, halo: int, sym: str = SYM, ts: str = TS,
               blocked: bool = True, keep_layout: bool = False, **layout_kw) -> DataFrame:
    """Lay out once, let ``build(df, carries)`` add columns, finish carries."""
    laid = lay_out(bars, sym, ts, halo=halo, blocked=blocked, **layout_kw)
    carries: dict = {}
    df = build(laid.df, carries)
    post = carries.pop("__post__", [])
    df = add_carry(laid.with_df(df), carries) if carries else df.where(F.col(OWN))
    for out, expr, _tmp in post:
        df = df.withColumn(out, expr)
    drop = [c for c in df.columns
            if c.startswith("_") and c not in LAYOUT_COLS and c not in bars.columns]
    df = df.drop(*drop)
    return df if keep_layout else df.drop(*LAYOUT_COLS)


def shift_forward(finished: DataFrame, column: str, n: int, out: str,
                  sym: str = SYM) -> DataFrame:
    """``shift(-n)`` across blocks: a keyed self-join on (symbol, row number).
    Needs the layout columns (``keep_layout=True``)."""
    ahead = finished.select(sym, (F.col(RN) - n).alias(RN), F.col(column).alias(out))
    return finished.join(ahead, [sym, RN], "left")


def lag_lead(bars: DataFrame, column: str = "close", lags=(1,), leads=(1,), *,
             sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """shift(n) / shift(-n) / diff() / pct_change() of one column."""
    require_columns(bars, [column], "lag_lead")
    for n in list(lags) + list(leads):
        require_window(n, "shift")

    def build(df, carries):
        cols = {f"{column}_lag_{n}": K.lag(column, n, sym) for n in lags}
        cols[f"{column}_diff"] = K.diff(column, 1, sym)
        cols[f"{column}_pct_change"] = K.pct_change(column, 1, sym)
        return df.withColumns(cols)

    out = run_series(bars, build, halo=max(list(lags) + [1]), sym=sym, ts=ts,
                     keep_layout=True, **kw)
    for n in leads:
        out = shift_forward(out, column, n, f"{column}_lead_{n}", sym)
    return out.drop(*LAYOUT_COLS)


def rolling_stats(bars: DataFrame, column: str = "close", window: int = 5, full: bool = False,
                  *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """min/max/mean/sum/std over the last ``window`` rows. Partial windows
    (``min_periods=1``) fill a one-row std with 0 as the reference does; full
    windows are null until ``window`` values are seen."""
    require_window(window)
    tag = "full" if full else "partial"

    def build(df, carries):
        std = K.rolling_std(column, window, sym, full)
        return df.withColumns({
            f"{column}_min_{tag}": K.rolling_min(column, window, sym, full),
            f"{column}_max_{tag}": K.rolling_max(column, window, sym, full),
            f"{column}_mean_{tag}": K.rolling_mean(column, window, sym, full),
            f"{column}_sum_{tag}": K.rolling_sum(column, window, sym, full),
            f"{column}_std_{tag}": std if full else F.coalesce(std, F.lit(0.0)),
        })

    return run_series(bars, build, halo=window, sym=sym, ts=ts, **kw)


def cumulative_stats(bars: DataFrame, column: str = "volume", *, sym: str = SYM,
                     ts: str = TS, **kw) -> DataFrame:
    """Running sum, mean, max and min from the first row (carried across blocks)."""
    def build(df, carries):
        x = F.col(column).cast("double")
        df = df.withColumns({"_cs": K.local_cumsum(x, sym), "_cn": K.local_cumsum(F.lit(1), sym),
                             "_cx": K.local_cummax(x, sym), "_cm": K.local_cummin(x, sym)})
        carries.update({f"_{column}_cumsum": ("_cs", "sum"), "_n": ("_cn", "sum"),
                        f"{column}_cummax": ("_cx", "max"), f"{column}_cummin": ("_cm", "min")})
        carries["__post__"] = [
            (f"{column}_cumsum", F.col(f"_{column}_cumsum"), []),
            (f"{column}_cummean", F.col(f"_{column}_cumsum") / F.col("_n"), [])]
        return df

    return run_series(bars, build, halo=0, sym=sym, ts=ts, **kw)


def running_extreme(bars: DataFrame, column: str = "close", *, sym: str = SYM, ts: str = TS,
                    **kw) -> DataFrame:
    """Running peak and trough (high-water / low-water marks) and drawdown."""
    def build(df, carries):
        df = df.withColumns({"_pk": K.local_cummax(column, sym), "_tr": K.local_cummin(column, sym)})
        carries.update({"running_peak": ("_pk", "max"), "running_trough": ("_tr", "min")})
        carries["__post__"] = [("drawdown", F.try_divide(F.col("running_peak") - F.col(column),
                                                         F.col("running_peak")), [])]
        return df

    return run_series(bars, build, halo=0, sym=sym, ts=ts, **kw)


def fill(bars: DataFrame, column: str, method: str = "ffill", *, sym: str = SYM, ts: str = TS,
         out: str | None = None, **kw) -> DataFrame:
    """ffill / bfill / linear interpolate by row position (leading nulls stay
    null, trailing nulls take the last value, as pandas does)."""
    out = out or f"{column}_{method}"
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown fill method {method!r}")

    def build(df, carries):
        x = F.col(column)
        if method == "ffill":
            df = df.withColumn("_f", K.local_ffill(x, sym))
            carries[out] = ("_f", "last")
        elif method == "bfill":
            df = df.withColumn("_b", K.local_bfill(x, sym))
            carries[out] = ("_b", "next")
        else:
            pt = F.when(x.isNotNull(), F.struct(F.col(RN).alias("r"), x.alias("v")))
            df = df.withColumns({"_pf": K.local_ffill(pt, sym), "_pb": K.local_bfill(pt, sym)})
            carries.update({"_prev": ("_pf", "last"), "_next": ("_pb", "next")})
            prev, nxt = F.col("_prev"), F.col("_next")
            val = (F.when(x.isNotNull(), x)
                   .when(prev.isNull(), F.lit(None))
                   .when(nxt.isNull(), prev["v"])
                   .otherwise(prev["v"] + (nxt["v"] - prev["v"])
                              * (F.col(RN) - prev["r"]) / (nxt["r"] - prev["r"])))
            carries["__post__"] = [(out, val, [])]
        return df

    return run_series(bars, build, halo=0, sym=sym, ts=ts, keep_layout=method == "interpolate",
                      **kw).drop(*LAYOUT_COLS)
