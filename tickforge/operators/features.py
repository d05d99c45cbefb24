"""Feature engineering, scalers and splits.

Fitted statistics (scalers, imputers) come from one aggregate pass and are
applied through a broadcast join of a one-row (or one-row-per-symbol) table,
fitted on the training rows only by default. Row-wise look-backs use the
block layout, so a hot symbol never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.layout import RN, key_count, maybe_broadcast, series_window, with_scalars
from ..schema import SYM, TS
from .series import run_series

LAGS = (1, 2, 3, 5, 10)
WINDOWS = (5, 10, 20)


def lag_features(bars: DataFrame, column: str = "close", lags=LAGS, *, fill_back: bool = False,
                 sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """``{column}_lag_{n}``. Forward fill commutes with a shift, so the
    filled variant is ffill applied to the lagged columns; ``fill_back``
    (the reference's variant A) also back-fills and therefore leaks."""
    if column not in bars.columns:
        return bars

    def build(df, carries):
        cols = {f"_l{n}": K.lag(column, n, sym) for n in lags}
        df = df.withColumns(cols)
        df = df.withColumns({f"_f{n}": K.local_ffill(f"_l{n}", sym) for n in lags})
        for n in lags:
            carries[f"{column}_lag_{n}"] = (f"_f{n}", "last")
        if fill_back:
            df = df.withColumns({f"_b{n}": K.local_bfill(f"_l{n}", sym) for n in lags})
            for n in lags:
                carries[f"_bk{n}"] = (f"_b{n}", "next")
            carries["__post__"] = [(f"{column}_lag_{n}", F.coalesce(f"{column}_lag_{n}",
                                                                   f"_bk{n}"), [])
                                   for n in lags]
        return df

    return run_series(bars, build, halo=max(lags), sym=sym, ts=ts, **kw)


def rolling_features(bars: DataFrame, column: str = "close", windows=WINDOWS,
                     method: str | None = None, *, sym: str = SYM, ts: str = TS,
                     **kw) -> DataFrame:
    """``{column}_rolling_mean_{n}`` / ``_std_{n}`` over full windows; gap
    policy ``pad`` (forward fill), ``interpolate`` (linear by row, leading
    nulls stay) or ``mean`` (column mean) for the nulls."""
    def build(df, carries):
        cols = {}
        for n in windows:
            cols[f"{column}_rolling_mean_{n}"] = K.rolling_mean(column, n, sym, full=True)
            cols[f"{column}_rolling_std_{n}"] = K.rolling_std(column, n, sym, full=True)
        df = df.withColumns(cols)
        if method == "pad":
            for name in list(cols):
                df = df.withColumn(f"_p_{name}", K.local_ffill(name, sym))
                carries[f"_pad_{name}"] = (f"_p_{name}", "last")
            carries["__post__"] = [(name, F.col(f"_pad_{name}"), []) for name in cols]
        return df

    out = run_series(bars, build, halo=max(windows), sym=sym, ts=ts, **kw)
    if method == "interpolate":
        from .series import fill
        for n in windows:
            for k in ("mean", "std"):
                name = f"{column}_rolling_{k}_{n}"
                out = fill(out, name, "interpolate", sym=sym, ts=ts, out=name, **kw)
    elif method == "mean":
        names = [f"{column}_rolling_{k}_{n}" for n in windows for k in ("mean", "std")]
        st = out.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
        out = with_scalars(out, st).withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in names}).drop(
            *[f"_m_{c}" for c in names])
    elif method not in (None, "pad", "interpolate"):
        raise ValueError(f"unknown gap policy {method!r}")
    return out


def rf_feature_set(bars: DataFrame, *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """lag_1/5/10, rolling_mean_5, rolling_std_5, strict RSI(14); null rows dropped."""
    from .indicators import rsi

    def build(df, carries):
        df = df.withColumns({"lag_1": K.lag("close", 1, sym), "lag_5": K.lag("close", 5, sym),
                             "lag_10": K.lag("close", 10, sym),
                             "rolling_mean_5": K.rolling_mean("close", 5, sym, full=True),
                             "rolling_std_5": K.rolling_std("close", 5, sym, full=True)})
        return rsi(df, carries, sym, 14, "strict")

    return run_series(bars, build, halo=15, sym=sym, ts=ts, **kw).na.drop()


def with_row_index(bars: DataFrame, *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """Exact per-symbol row number ``rn`` and row count ``n`` (skew-safe)."""
    out = run_series(bars, lambda df, c: df.withColumn("rn", F.col(RN)), halo=0, sym=sym,
                     ts=ts, **kw)
    # from the bars themselves, not from the numbered rows: no second sort of the table
    counts = bars.where(F.col(sym).isNotNull() & F.col(ts).isNotNull()).groupBy(sym).agg(F.count(F.lit(1)).alias("n"))
    return out.join(maybe_broadcast(counts, key_count(bars, sym)), sym)


# ------------------------------------------------------------------ splits
def split_random(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42,
                 out: str = "is_test") -> DataFrame:
    """Deterministic hash split (same rows in any engine with md5)."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), 1, 8),
               16, 10).cast("bigint")
    return df.withColumn(out, (h % 100) < test_pct)


def split_chronological(bars: DataFrame, train_ratio: float = 0.8, *, sym: str = SYM,
                        ts: str = TS, **kw) -> DataFrame:
    """First ``floor(n * ratio)`` rows of every symbol are train."""
    idx = with_row_index(bars, sym=sym, ts=ts, **kw)
    return idx.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") * train_ratio),
                                          "train").otherwise("test"))


def time_series_folds(bars: DataFrame, k: int = 5, *, sym: str = SYM, ts: str = TS,
                      **kw) -> DataFrame:
    """Expanding folds: test size n // (k+1); fold i tests rows
    [n - (k-i)*size, n - (k-i-1)*size), trains on everything before. One
    output row per (bar, fold) the bar takes part in."""
    idx = with_row_index(bars, sym=sym, ts=ts, **kw)
    size = F.floor(F.col("n") / (k + 1))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    x = idx.withColumn("fold", F.explode(folds))
    start = F.col("n") - (k - F.col("fold")) * size
    role = (F.when(F.col("rn") - 1 < start, "train")
            .when(F.col("rn") - 1 < start + size, "test"))
    return x.withColumn("role", role).where(F.col("role").isNotNull())


def kfold(bars: DataFrame, k: int = 5, *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    idx = with_row_index(bars, sym=sym, ts=ts, **kw)
    return idx.withColumn("fold", F.floor((F.col("rn") - 1) * k / F.col("n")).cast("int"))


# ----------------------------------------------------------------- scalers
def fit_scaler(df: DataFrame, columns, kind: str = "standard", by=None) -> DataFrame:
    """One-row (or one row per ``by`` group) table of fitted statistics."""
    aggs = []
    for c in columns:
        x = F.col(c)
        if kind == "standard":
            aggs += [F.avg(x).alias(f"{c}__a"), F.stddev_pop(x).alias(f"{c}__b")]
        elif kind == "minmax":
            aggs += [F.min(x).alias(f"{c}__a"), F.max(x).alias(f"{c}__b")]
        elif kind == "robust":
            continue  # exact quartiles come from the order-statistics plan below
        elif kind == "maxabs":
            aggs += [F.max(F.abs(x)).alias(f"{c}__b")]
        else:
            raise ValueError(f"unknown scaler {kind!r}")
    if kind == "robust":
        from ..functions.quantiles import quantiles
        fitted = None
        for c in columns:
            q = quantiles(df, c, [0.25, 0.5, 0.75], by=by or (), names=["_q1", "_q2", "_q3"])
            q = q.select(*(by or []), F.col("_q2").alias(f"{c}__a"),
                         (F.col("_q3") - F.col("_q1")).alias(f"{c}__b"))
            fitted = q if fitted is None else (fitted.join(q, by) if by else
                                               with_scalars(fitted, q))
        return fitted
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def apply_scaler(df: DataFrame, fitted: DataFrame, columns, kind: str = "standard", by=None,
                 suffix: str = "", how: str = "inner") -> DataFrame:
    """sklearn-compatible transforms; zero scale maps to 1 (constants -> 0). With ``how="left"``
    rows of groups without statistics stay, their scaled columns null."""
    # per-group statistics: one row per key of the input, broadcast only if bounded
    joined = (df.join(maybe_broadcast(fitted, key_count(df, *by)), by, how) if by
              else with_scalars(df, fitted))
    out = {}
    for c in columns:
        a, b = F.col(f"{c}__a"), F.col(f"{c}__b")
        if kind == "standard" or kind == "robust":
            scale = F.when((b == 0) | b.isNull(), F.lit(1.0)).otherwise(b)
            out[c + suffix] = (F.col(c) - a) / scale
        elif kind == "minmax":
            rng = b - a
            out[c + suffix] = (F.col(c) - a) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        elif kind == "maxabs":
            out[c + suffix] = F.col(c) / F.when(b == 0, F.lit(1.0)).otherwise(b)
    drop = [x for x in fitted.columns if "__" in x]
    return joined.withColumns(out).drop(*drop)


def inverse_scaler(df: DataFrame, fitted: DataFrame, columns, kind: str = "minmax", by=None,
                   suffix: str = "_inv") -> DataFrame:
    # per-group statistics: one row per key of the input, broadcast only if bounded
    joined = (df.join(maybe_broadcast(fitted, key_count(df, *by)), by) if by
              else with_scalars(df, fitted))
    out = {}
    for c in columns:
        a, b = F.col(f"{c}__a"), F.col(f"{c}__b")
        if kind == "minmax":
            rng = b - a
            out[c + suffix] = F.col(c) * F.when(rng == 0, F.lit(1.0)).otherwise(rng) + a
        elif kind in ("standard", "robust"):
            out[c + suffix] = F.col(c) * F.when(b == 0, F.lit(1.0)).otherwise(b) + a
        else:
            out[c + suffix] = F.col(c) * F.when(b == 0, F.lit(1.0)).otherwise(b)
    return joined.withColumns(out).drop(*[x for x in fitted.columns if "__" in x])


def normalizer_l2(df: DataFrame, columns, suffix: str = "_l2") -> DataFrame:
    """Row-wise x / ||row||_2; an all-zero row is unchanged."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.withColumns({c + suffix: F.when(norm == 0, F.col(c)).otherwise(F.col(c) / norm)
                           for c in columns})


# ------------------------------------------------------------- sequences
def sequence_windows(bars: DataFrame, columns=("close",), target: str = "close",
                     time_steps: int = 10, *, sym: str = SYM, ts: str = TS,
                     **kw) -> DataFrame:
    """X = the previous ``time_steps`` rows (array of row arrays), y = target
    at the current row; rows without a full history are dropped."""
    def build(df, carries):
        w = series_window(sym).rowsBetween(-time_steps, -1)
        row = F.array(*[F.col(c).cast("double") for c in columns])
        return df.withColumns({"X": F.collect_list(row).over(w), "y": F.col(target)})

    out = run_series(bars, build, halo=time_steps, sym=sym, ts=ts, **kw)
    return out.where(F.size("X") == time_steps)


def scaled_sequences(bars: DataFrame, columns=("volume",), target: str = "close", time_steps: int = 10,
                     train_ratio: float = 0.8, fit_on: str = "train", *, sym: str = SYM, ts: str = TS,
                     **kw) -> tuple[DataFrame, DataFrame]:
    """Sequences of min-max scaled rows, and the target's own scaler to undo ``y`` with (``inverse_scaler``).

    X = the previous ``time_steps`` rows, each the scaled ``columns`` and then the scaled
    target; y = the scaled target. Rows with a null, NaN or infinite value are left out
    first. The first ``floor(sequences * train_ratio)`` sequences of a symbol train.
    Scalers are per symbol, on the rows the train sequences see (``fit_on="all"``: on all)."""
    from ..plans.layout import stored
    columns = [c for c in columns if c != target]
    every = [*columns, target]
    rows = bars.select(sym, ts, *[F.col(c).cast("double").alias(c) for c in every])
    for c in every:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = stored(with_row_index(rows, sym=sym, ts=ts, **kw), "sequence-rows")
    last = time_steps + F.floor((F.col("n") - time_steps) * train_ratio)
    fitted_on = rows if fit_on == "all" else rows.where(F.col("rn") <= last)
    feature_fit = fit_scaler(fitted_on, columns, "minmax", [sym]) if columns else None
    target_fit = stored(fit_scaler(fitted_on, [target], "minmax", [sym]), "target-scaler")
    scaled = rows.withColumn("split", F.when(F.col("rn") <= last, "train").otherwise("test")).drop("rn", "n")
    if columns:
        scaled = apply_scaler(scaled, feature_fit, columns, "minmax", [sym])
    scaled = apply_scaler(scaled, target_fit, [target], "minmax", [sym])
    return sequence_windows(scaled, every, target, time_steps, sym=sym, ts=ts, **kw), target_fit


def standard_scale_split(df: DataFrame, columns, split_col: str = "split",
                         fit_on: str = "train") -> DataFrame:
    """Fit a standard scaler on the train rows (or all) and apply it to all."""
    src = df.where(F.col(split_col) == "train") if fit_on == "train" else df
    return apply_scaler(df, fit_scaler(src, columns, "standard"), columns, "standard")


__all__ = ["lag_features", "rolling_features", "rf_feature_set", "with_row_index",
           "split_random", "split_chronological", "time_series_folds", "kfold", "fit_scaler",
           "apply_scaler", "inverse_scaler", "normalizer_l2", "sequence_windows",
           "standard_scale_split", "scaled_sequences"]
