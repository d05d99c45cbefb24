"""Walk-forward forecasts: a stationarity decision per series, then an expanding AR(1).

Per series the first 80 % of the rows fix everything that is fixed: mean and
deviation for standardising, the unit-root statistic that decides whether the
series is differenced, and the mean its steps are centred on. Every later row
is forecast from the rows before it only, whose actual values are revealed.

The regression of each row on the rows before it takes centred moments: inside
a block a running window (Spark's covariance aggregates update means and
centred products, no raw squares), across blocks one row per block whose
moments are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.layout import BLK, LAYOUT_COLS, OWN, key_count, lay_out, maybe_broadcast, series_window, stored
from ..schema import SYM, TS, require_columns
from .features import split_chronological

#: 5 % critical value of the unit-root test with a constant, for long series.
UNIT_ROOT_5 = -2.86


def unit_root(df: DataFrame, value: str, before: str, by: str = SYM) -> DataFrame:
    """Dickey-Fuller statistic ``tau`` of each series from (value, value before) pairs; null where undefined."""
    step = F.col(value) - F.col(before)
    g = df.groupBy(by).agg(F.regr_slope(step, before).alias("_b"), F.regr_sxx(step, before).alias("_sxx"),
                           F.regr_syy(step, before).alias("_syy"), F.regr_count(step, before).alias("_n"))
    left = F.greatest(F.col("_syy") - F.col("_b") ** 2 * F.col("_sxx"), F.lit(0.0))
    error = F.when(F.col("_n") > 2, F.sqrt(F.try_divide(F.try_divide(left, F.col("_n") - 2), F.col("_sxx"))))
    return g.select(by, F.try_divide("_b", error).alias("tau"))


def fit_series(bars: DataFrame, value: str, train_ratio: float, *, sym: str = SYM, ts: str = TS, **layout) -> DataFrame:
    """One row a series: mean, scale, tau, stationary, and the time of the last train row."""
    rows = split_chronological(bars.select(sym, ts, F.col(value).cast("double").alias(value)), train_ratio, sym=sym,
                               ts=ts, **layout).where(F.col("split") == "train")
    laid = lay_out(rows.select(sym, ts, value), sym, ts, halo=1, **layout)
    pairs = stored(laid.df.withColumn("_before", K.lag(value, 1, sym)).where(F.col(OWN))
                   .select(sym, ts, value, "_before"), "train-pairs")
    base = pairs.groupBy(sym).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"),
                                  F.max(ts).alias("_cut"), F.avg(F.col(value) - F.col("_before")).alias("_drift"))
    out = base.join(unit_root(pairs, value, "_before", sym), sym)
    scale = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return out.select(sym, "mean", scale.alias("scale"), "tau",
                      F.coalesce(F.col("tau") < UNIT_ROOT_5, F.lit(False)).alias("stationary"), "_cut",
                      F.col("_drift"))


def _moments(y: str, x: str, over=None) -> dict:
    """Count, means and centred products of the pairs (y, x), as aggregates or over a window."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    y_, x_ = F.when(both, F.col(y)), F.when(both, F.col(x))
    n = F.count(y_)
    out = {"n": n, "mx": F.avg(x_), "my": F.avg(y_), "vx": F.var_pop(x_), "cxy": F.covar_pop(x_, y_)}
    return {k: v.over(over) for k, v in out.items()} if over is not None else out


def walk_forward(bars: DataFrame, value: str = "close", train_ratio: float = 0.8, threshold: float = 1.0, *,
                 sym: str = SYM, ts: str = TS, **layout) -> DataFrame:
    """Rows after the train part with ``actual``, ``predicted``, ``differenced``, the series' ``mse`` and
    ``accepted`` (mse in units of the train variance at most ``threshold``).

    Rows with null values are left out first. A row has no forecast while fewer than
    two earlier pairs, or none that differ, exist; such rows do not come out. Rows at
    the time of the last train row count as train rows.
    """
    require_columns(bars, [sym, ts, value], "walk_forward")
    bars = bars.select(sym, ts, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    fitted = stored(fit_series(bars, value, train_ratio, sym=sym, ts=ts, **layout), "series-fits")
    n_sym = key_count(bars, sym)
    z = bars.join(maybe_broadcast(fitted, n_sym), sym)
    z = z.withColumn("_z", (F.col(value) - F.col("mean")) / F.col("scale"))
    laid = lay_out(z, sym, ts, halo=2, **layout)
    steady = F.col("stationary")
    drift = F.coalesce(F.col("_drift"), F.lit(0.0)) / F.col("scale")
    back = K.lag("_z", 1, sym)
    # the modelled series: levels, or steps less their train mean
    df = laid.df.withColumns({"_back": back, "_x": F.when(steady, F.col("_z")).otherwise(F.col("_z") - back - drift)})
    df = df.withColumn("_x1", K.lag("_x", 1, sym))
    df = df.withColumn("_y", F.when(F.col(OWN), F.col("_x")))
    earlier = series_window(sym).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_i_{k}": c for k, c in _moments("_y", "_x1", earlier).items()}).where(F.col(OWN))
    df = _with_earlier_blocks(df, laid, sym) if laid.blocked else df.withColumns(
        {f"_m_{k}": F.col(f"_i_{k}") for k in ("n", "mx", "my", "vx", "cxy")})
    slope = F.when((F.col("_m_n") >= 2) & (F.col("_m_vx") > 0), F.try_divide("_m_cxy", "_m_vx"))
    ahead = F.col("_m_my") + slope * (F.col("_x1") - F.col("_m_mx"))
    z_hat = F.when(steady, ahead).otherwise(F.col("_back") + drift + ahead)
    df = df.withColumns({"_e": F.col("_z") - z_hat, "predicted": F.col("mean") + F.col("scale") * z_hat})
    out = df.where((F.col(ts) > F.col("_cut")) & F.col("predicted").isNotNull())
    out = stored(out.select(sym, ts, F.col(value).alias("actual"), "predicted", (~steady).alias("differenced"), "_e"),
                 "forecasts")
    score = out.groupBy(sym).agg(F.avg(F.col("_e") * F.col("_e")).alias("mse"))
    out = out.join(maybe_broadcast(score, n_sym), sym).withColumn("accepted", F.col("mse") <= threshold)
    return out.drop("_e", *LAYOUT_COLS)


def _with_earlier_blocks(df: DataFrame, laid, sym: str) -> DataFrame:
    """Merge each row's in-block moments with those of all earlier blocks (one row a block)."""
    ends = df.groupBy(sym, BLK).agg(*[c.alias(f"_b_{k}") for k, c in _moments("_y", "_x1").items()])
    n = F.col("_b_n")
    # x is centred on the train part, so the block means are small against the spread
    parts = {"n": n, "x": n * F.coalesce("_b_mx", F.lit(0.0)), "y": n * F.coalesce("_b_my", F.lit(0.0)),
             "xx": n * F.coalesce(F.col("_b_vx") + F.col("_b_mx") ** 2, F.lit(0.0)),
             "xy": n * F.coalesce(F.col("_b_cxy") + F.col("_b_mx") * F.col("_b_my"), F.lit(0.0))}
    before = Window.partitionBy(sym).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(sym, BLK, *[F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(f"_t_{k}")
                                   for k, v in parts.items()])
    mx, my = F.try_divide("_t_x", "_t_n"), F.try_divide("_t_y", "_t_n")
    ends = ends.select(sym, BLK, F.col("_t_n").alias("_p_n"), mx.alias("_p_mx"), my.alias("_p_my"),
                       (F.col("_t_xx") - F.col("_t_n") * mx * mx).alias("_p_sxx"),
                       (F.col("_t_xy") - F.col("_t_n") * mx * my).alias("_p_sxy"))
    df = df.join(maybe_broadcast(ends, laid.blocks.count()), [sym, BLK])
    zero = F.lit(0.0)
    a, b = F.col("_p_n"), F.col("_i_n")
    total = a + b
    ax, ay, bx, by = (F.coalesce(c, zero) for c in ("_p_mx", "_p_my", "_i_mx", "_i_my"))
    weight = F.coalesce(F.try_divide(a * b, total), zero)
    sxx = F.coalesce("_p_sxx", zero) + F.coalesce(b * F.col("_i_vx"), zero) + weight * (ax - bx) ** 2
    sxy = F.coalesce("_p_sxy", zero) + F.coalesce(b * F.col("_i_cxy"), zero) + weight * (ax - bx) * (ay - by)
    return df.withColumns({"_m_n": total, "_m_mx": F.try_divide(a * ax + b * bx, total),
                           "_m_my": F.try_divide(a * ay + b * by, total),
                           "_m_vx": F.try_divide(sxx, total), "_m_cxy": F.try_divide(sxy, total)})
