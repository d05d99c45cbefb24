"""Registered queries: features (§2.8), scalers, splits (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators.preprocess import preprocess
from ..operators.synthesis import deep_features, plan
from ..plans.layout import with_scalars
from ..session import scratch_path
from ..sources.tables import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars, read_table
from .catalog_indicators import spark_round
from .sqlkit import P, cum, full, rnd

LB = f"({LINE_BARS_SQL})"


def _r(df, keep, cols, digits=6):
    return df.select(*keep, *[spark_round(c, digits).alias(c) for c in cols])


def q_lag_features(spark, sf_dir):
    out = FE.lag_features(line_bars(spark, sf_dir))
    return _r(out, ["symbol", "ts"], [f"close_lag_{n}" for n in FE.LAGS])


SQL_LAG_FEATURES = ("SELECT symbol, ts, " + ", ".join(
    f"{rnd(f'lag(close, {n}) OVER ({P})')} AS close_lag_{n}" for n in FE.LAGS) + f" FROM {LB} b")


def q_rolling_features(spark, sf_dir):
    out = FE.rolling_features(line_bars(spark, sf_dir))
    cols = [f"close_rolling_{k}_{n}" for n in FE.WINDOWS for k in ("mean", "std")]
    return _r(out, ["symbol", "ts"], cols)


SQL_ROLLING_FEATURES = ("SELECT symbol, ts, " + ", ".join(
    f"{rnd(full(a, 'close', n))} AS close_rolling_{k}_{n}" for n in FE.WINDOWS
    for k, a in (("mean", "avg"), ("std", "stddev_samp"))) + f" FROM {LB} b")


def q_rf_features(spark, sf_dir):
    out = FE.rf_feature_set(line_bars(spark, sf_dir))
    return _r(out, ["symbol", "ts"], ["lag_1", "lag_5", "lag_10", "rolling_mean_5",
                                      "rolling_std_5", "RSI"])


SQL_RF_FEATURES = f"""
WITH a AS (SELECT symbol, ts, close, lag(close, 1) OVER ({P}) AS lag_1, lag(close, 5) OVER ({P}) AS lag_5,
       lag(close, 10) OVER ({P}) AS lag_10, {full('avg', 'close', 5)} AS rolling_mean_5,
       {full('stddev_samp', 'close', 5)} AS rolling_std_5,
       close - lag(close) OVER ({P}) AS d FROM {LB} b),
g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END
      AS loss FROM a),
m AS (SELECT *, {full('avg', 'gain', 14)} AS ag, {full('avg', 'loss', 14)} AS al FROM g),
r AS (SELECT *, CASE WHEN al = 0 THEN (CASE WHEN ag > 0 THEN 100.0 END)
      ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS RSI FROM m)
SELECT symbol, ts, {', '.join(f'{rnd(c)} AS {c}' for c in ('lag_1', 'lag_5', 'lag_10',
                                                          'rolling_mean_5', 'rolling_std_5', 'RSI'))}
FROM r WHERE lag_10 IS NOT NULL AND rolling_std_5 IS NOT NULL AND RSI IS NOT NULL"""


PREPROCESSED = ["days_since", "open", "high", "low", "volume", "grade", "close_lag_1", "close_lag_2",
                "close_rolling_mean_5", "close_rolling_std_5"]


def q_preprocess(spark, sf_dir):
    """All steps on bars with a text column that holds a number on some rows only."""
    graded = line_bars(spark, sf_dir).withColumn("grade", F.when(F.col("volume") >= 30, F.col("volume").cast("string"))
                                                 .otherwise("thin"))
    out = preprocess(graded, "close", (1, 2), (5,), 0.8)
    return _r(out, ["symbol", "ts", "split"], PREPROCESSED + ["close"])


SQL_PREPROCESS = f"""
WITH b AS MATERIALIZED (SELECT *, CASE WHEN volume >= 30 THEN CAST(volume AS DOUBLE) END AS grade FROM {LB} q),
f AS MATERIALIZED (SELECT *, date_diff('day', min(ts) OVER (PARTITION BY symbol), ts) AS days_since,
       lag(close, 1) OVER ({P}) AS close_lag_1, lag(close, 2) OVER ({P}) AS close_lag_2,
       {full('avg', 'close', 5)} AS close_rolling_mean_5, {full('stddev_samp', 'close', 5)} AS close_rolling_std_5
       FROM b),
d AS (SELECT * FROM f WHERE close_lag_2 IS NOT NULL AND close_rolling_std_5 IS NOT NULL),
s AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER ({P}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8)
      THEN 'train' ELSE 'test' END AS split FROM d),
m AS MATERIALIZED (SELECT {', '.join(f"avg({c}) AS {c}" for c in PREPROCESSED)} FROM s WHERE split = 'train'),
i AS MATERIALIZED (SELECT symbol, ts, split, close,
       {', '.join(f"coalesce(s.{c}, m.{c}) AS {c}" for c in PREPROCESSED)} FROM s, m),
t AS MATERIALIZED (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREPROCESSED)}
      FROM i WHERE split = 'train')
SELECT symbol, ts, split, {rnd('close')} AS close,
       {', '.join(f"{rnd(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in PREPROCESSED)} FROM i, t"""


def q_dfs(spark, sf_dir):
    made = [f.name for f in plan(("close", "volume"))]
    out = deep_features(event_bars(spark, sf_dir))
    return out.select("symbol", "ts", *[spark_round(f"`{c}`", 3).alias(c) for c in made])


def sql_dfs():
    running = (("CUM_SUM", "sum"), ("CUM_MEAN", "avg"))
    first = {f"{n}({c})": f'{a}(CAST({c} AS DOUBLE)) {cum()}' for c in ("close", "volume") for n, a in running}
    second = {f"{n}({c})": f'{a}("{c}") {cum()}' for c in first for n, a in running}
    whole = {f"{n}({c})": f'{f}(CAST("{c}" AS DOUBLE)) OVER (PARTITION BY symbol)'
             for c in ("close", "volume", *first)
             for n, f in (("MEAN", "avg"), ("SUM", "sum"), ("COUNT", "count"), ("MAX", "max"), ("MIN", "min"))}
    dates = {"DAY(ts)": "day(ts)", "MONTH(ts)": "month(ts)", "YEAR(ts)": "year(ts)", "WEEKDAY(ts)": "isodow(ts) - 1"}

    def columns(exprs):
        return ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())

    every = [*dates, *first, *second, *whole]
    rounded = ", ".join(f"""{rnd(f'"{n}"', 3)} AS "{n}\"""" for n in every)
    return f"""
WITH a AS (SELECT *, {columns(first)}, {columns(dates)} FROM ({EVENT_BARS_SQL}) b),
c AS (SELECT *, {columns(second)}, {columns(whole)} FROM a)
SELECT symbol, ts, {rounded} FROM c"""


def q_feature_store(spark, sf_dir):
    path = scratch_path(spark, "features")
    feats = FE.lag_features(line_bars(spark, sf_dir), "close", (1, 5))
    feats.write.mode("errorifexists").option("header", True).csv(path)
    back = spark.read.option("header", True).schema(feats.schema).csv(path)
    return _r(back, ["symbol", "ts"], ["close", "close_lag_1", "close_lag_5"])


SQL_FEATURE_STORE = (f"SELECT symbol, ts, {rnd('close')} AS close, "
                     f"{rnd(f'lag(close, 1) OVER ({P})')} AS close_lag_1, "
                     f"{rnd(f'lag(close, 5) OVER ({P})')} AS close_lag_5 FROM {LB} b")


def q_impute_mean(spark, sf_dir):
    b = line_bars(spark, sf_dir).withColumn("px", F.when(F.col("volume") >= 30, F.col("close")))
    st = b.agg(F.avg("px").alias("_m"))
    out = with_scalars(b, st).withColumn("px", F.coalesce("px", "_m"))
    return _r(out, ["symbol", "ts"], ["px"])


SQL_IMPUTE = (f"SELECT symbol, ts, {rnd('coalesce(px, avg(px) OVER ())')} AS px FROM "
              f"(SELECT *, CASE WHEN volume >= 30 THEN close END AS px FROM {LB} b) t")


def q_sequences(spark, sf_dir):
    out = FE.sequence_windows(event_bars(spark, sf_dir), ("close", "volume"), "close", 10)
    flat = F.flatten("X")
    return out.select("symbol", "ts", spark_round(F.aggregate(
        flat, F.lit(0.0), lambda a, x: a + x)).alias("x_sum"),
        spark_round(F.col("X")[0][0]).alias("x_first_close"),
        spark_round(F.col("X")[9][1]).alias("x_last_volume"),
        F.size("X").alias("steps"), spark_round("y").alias("y"))


SQL_SEQUENCES = f"""
WITH s AS (SELECT symbol, ts, close,
  list(close) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS xc,
  list(CAST(volume AS DOUBLE)) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS xv
  FROM ({EVENT_BARS_SQL}) b)
SELECT symbol, ts, {rnd('list_sum(list_transform(range(1, 11), lambda i: xc[i] + xv[i]))')} AS x_sum,
       {rnd('xc[1]')} AS x_first_close, {rnd('xv[10]')} AS x_last_volume,
       CAST(len(xc) AS INTEGER) AS steps, {rnd('close')} AS y
FROM s WHERE len(xc) = 10"""


def q_scaled_sequences(spark, sf_dir):
    """10-step sequences of scaled volume and close; ``y_price`` undoes the target's own scaler."""
    seq, target = FE.scaled_sequences(event_bars(spark, sf_dir), ("volume",), "close", 10)
    seq = FE.inverse_scaler(seq.drop("close").withColumnRenamed("y", "close"), target, ["close"], "minmax", ["symbol"])
    total = F.aggregate(F.flatten("X"), F.lit(0.0), lambda a, x: a + x)
    return seq.select("symbol", "ts", "split", spark_round(total).alias("x_sum"),
                      spark_round(F.col("X")[0][0]).alias("x_first_volume"), spark_round("close").alias("y"),
                      spark_round("close_inv").alias("y_price"))


SQL_SCALED_SEQ = f"""
WITH b AS (SELECT *, row_number() OVER ({P}) AS rn, 10 + floor((count(*) OVER (PARTITION BY symbol) - 10) * 0.8) AS lst
           FROM ({EVENT_BARS_SQL}) q),
f AS (SELECT symbol, min(close) AS lo, max(close) AS hi, min(volume) AS vlo, max(volume) AS vhi
      FROM b WHERE rn <= lst GROUP BY symbol),
c AS (SELECT b.symbol, ts, close, CASE WHEN rn <= lst THEN 'train' ELSE 'test' END AS split,
             (close - lo) / (CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END) AS x,
             (volume - vlo) / (CASE WHEN vhi - vlo = 0 THEN 1.0 ELSE vhi - vlo END) AS v
      FROM b JOIN f USING (symbol)),
w AS (SELECT *, list(x) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS xs,
             list(v) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS vs FROM c)
SELECT symbol, ts, split, {rnd('list_sum(list_transform(range(1, 11), lambda i: vs[i] + xs[i]))')} AS x_sum,
       {rnd('vs[1]')} AS x_first_volume, {rnd('x')} AS y, {rnd('close')} AS y_price FROM w WHERE len(xs) = 10"""


def q_inverse_scale(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    fitted = FE.fit_scaler(bars, ["close"], "minmax", ["symbol"])
    scaled = FE.apply_scaler(bars, fitted, ["close"], "minmax", ["symbol"])
    back = FE.inverse_scaler(scaled, fitted, ["close"], "minmax", ["symbol"])
    return _r(back, ["symbol", "ts"], ["close_inv"], 4)


SQL_INVERSE = f"SELECT symbol, ts, {rnd('close', 4)} AS close_inv FROM {LB} b"

SCALE_COLS = ["open", "high", "low", "close"]


def _q_scaler(kind):
    def run(spark, sf_dir):
        bars = line_bars(spark, sf_dir)
        out = FE.apply_scaler(bars, FE.fit_scaler(bars, SCALE_COLS, kind), SCALE_COLS, kind)
        return _r(out, ["symbol", "ts"], SCALE_COLS)
    return run


def _sql_scaler(kind):
    exprs = []
    for c in SCALE_COLS:
        if kind == "standard":
            e = (f"({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
                 f"ELSE stddev_pop({c}) OVER () END)")
        elif kind == "minmax":
            e = (f"({c} - min({c}) OVER ()) / (CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 "
                 f"THEN 1.0 ELSE max({c}) OVER () - min({c}) OVER () END)")
        elif kind == "robust":
            iqr = f"(quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())"
            e = (f"({c} - quantile_cont({c}, 0.5) OVER ()) / (CASE WHEN {iqr} = 0 THEN 1.0 "
                 f"ELSE {iqr} END)")
        else:
            e = (f"{c} / (CASE WHEN max(abs({c})) OVER () = 0 THEN 1.0 ELSE max(abs({c})) "
                 f"OVER () END)")
        exprs.append(f"{rnd(e)} AS {c}")
    return f"SELECT symbol, ts, {', '.join(exprs)} FROM {LB} b"


def q_normalizer(spark, sf_dir):
    out = FE.normalizer_l2(line_bars(spark, sf_dir), SCALE_COLS)
    return _r(out, ["symbol", "ts"], [c + "_l2" for c in SCALE_COLS])


SQL_NORMALIZER = (f"SELECT symbol, ts, " + ", ".join(
    f"{rnd(f'CASE WHEN nrm = 0 THEN {c} ELSE {c} / nrm END')} AS {c}_l2" for c in SCALE_COLS)
    + f" FROM (SELECT *, sqrt(open*open + high*high + low*low + close*close) AS nrm FROM {LB} b) q")


def q_split_random(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return FE.split_random(ev, "event_id")


SQL_SPLIT_RANDOM = ("SELECT event_id, event_type, (('0x' || substr(md5(CAST(event_id AS VARCHAR) "
                    "|| '42'), 1, 8))::BIGINT % 100) < 20 AS is_test FROM events")


def q_split_chrono(spark, sf_dir):
    out = FE.split_chronological(line_bars(spark, sf_dir), 0.8)
    return out.select("symbol", "ts", "split")


SQL_SPLIT_CHRONO = (f"SELECT symbol, ts, CASE WHEN row_number() OVER ({P}) <= floor(count(*) OVER "
                    f"(PARTITION BY symbol) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {LB} b")


def q_ts_folds(spark, sf_dir):
    out = FE.time_series_folds(line_bars(spark, sf_dir), 5)
    return out.select("symbol", "ts", "fold", "role")


SQL_TS_FOLDS = f"""
WITH b AS (SELECT symbol, ts, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY symbol) AS n
           FROM {LB} q),
x AS (SELECT *, CAST(f AS INTEGER) AS fold, n - (5 - f) * floor(n / 6) AS st, floor(n / 6) AS sz
      FROM b, range(0, 5) t(f))
SELECT symbol, ts, fold, CASE WHEN rn - 1 < st THEN 'train' ELSE 'test' END AS role
FROM x WHERE rn - 1 < st + sz"""


def q_kfold(spark, sf_dir):
    return FE.kfold(line_bars(spark, sf_dir), 5).select("symbol", "ts", "fold")


SQL_KFOLD = (f"SELECT symbol, ts, CAST(floor((row_number() OVER ({P}) - 1) * 5 / count(*) OVER "
             f"(PARTITION BY symbol)) AS INTEGER) AS fold FROM {LB} b")


def catalog():
    return {
        "lag_features": (q_lag_features, SQL_LAG_FEATURES),
        "rolling_features": (q_rolling_features, SQL_ROLLING_FEATURES),
        "rf_feature_set": (q_rf_features, SQL_RF_FEATURES),
        "preprocess_pipeline": (q_preprocess, SQL_PREPROCESS),
        "deep_feature_synthesis": (q_dfs, sql_dfs()),
        "feature_store_io": (q_feature_store, SQL_FEATURE_STORE),
        "impute_mean": (q_impute_mean, SQL_IMPUTE),
        "sequence_windows": (q_sequences, SQL_SEQUENCES),
        "scaled_sequences": (q_scaled_sequences, SQL_SCALED_SEQ),
        "inverse_scale": (q_inverse_scale, SQL_INVERSE),
        "standard_scaler": (_q_scaler("standard"), _sql_scaler("standard")),
        "minmax_scaler": (_q_scaler("minmax"), _sql_scaler("minmax")),
        "robust_scaler": (_q_scaler("robust"), _sql_scaler("robust")),
        "maxabs_scaler": (_q_scaler("maxabs"), _sql_scaler("maxabs")),
        "normalizer_l2": (q_normalizer, SQL_NORMALIZER),
        "split_random": (q_split_random, SQL_SPLIT_RANDOM),
        "split_chronological": (q_split_chrono, SQL_SPLIT_CHRONO),
        "time_series_folds": (q_ts_folds, SQL_TS_FOLDS),
        "kfold": (q_kfold, SQL_KFOLD),
    }

