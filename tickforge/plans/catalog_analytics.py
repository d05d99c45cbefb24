"""Registered queries: modelling and evaluation (§2.10), replay, performance,
risk and option P&L (§2.11)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.quantiles import quantiles
from ..operators import backtest as BT
from ..operators import features as FE
from ..operators import models as M
from ..operators.forecast import walk_forward
from ..operators.series import run_series
from ..plans.layout import key_count, maybe_broadcast, series_sizes, stored, with_scalars
from ..session import scratch_path
from ..sources.tables import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars, read_table
from .catalog_indicators import REC_DIGITS, _recursive, spark_round
from .sqlkit import P, rnd, tdiv

LB = f"({LINE_BARS_SQL})"
FEATS = ["open", "high", "low"]


def _r(df, keep, cols, digits=6):
    return df.select(*keep, *[spark_round(c, digits).alias(c) for c in cols])


def _naive(spark, sf_dir):
    def build(df, carries):
        return df.withColumns({"predicted": K.lag("close", 1, "symbol"),
                               "pred5": K.lag("close", 5, "symbol"),
                               "prev2": K.lag("close", 2, "symbol")})
    return run_series(line_bars(spark, sf_dir), build, halo=5)


# ------------------------------------------------------------------ models (rows-only)
def q_ridge(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    model = M.fit_ridge(bars, FEATS, "close", alpha=1.0)
    return model.transform(bars).select("symbol", "ts", spark_round("prediction", 4)
                                        .alias("prediction"))


def _det(m):
    """SQL of a determinant, expanded along its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {_det([r[:j] + r[j + 1:] for r in m[1:]])}"
                          for j in range(len(m))) + ")"


def sql_ridge_weights(features, label, alpha, src):
    """One row: weights w0.., feature means m0.. and label mean my of a ridge fit with a free
    intercept: the centred normal equations (X'X + alpha I) w = X'y solved by Cramer's rule."""
    x = list(features)
    k = range(len(x))
    cells = ", ".join([f"covar_pop({x[i]}, {x[j]}) * count(*){f' + {alpha}' if i == j else ''} AS a{i}{j}"
                       for i in k for j in k]
                      + [f"covar_pop({x[i]}, {label}) * count(*) AS b{i}" for i in k]
                      + [f"avg({c}) AS m{i}" for i, c in enumerate(x)] + [f"avg({label}) AS my"])
    a = [[f"a{i}{j}" for j in k] for i in k]
    swapped = [[[f"b{i}" if j == c else a[i][j] for j in k] for i in k] for c in k]
    return (f"SELECT {', '.join(f'{_det(swapped[c])} / {_det(a)} AS w{c}, m{c}' for c in k)}, my "
            f"FROM (SELECT {cells} FROM {src}) sums")


def sql_ridge(features, label, alpha, src, tag=""):
    pred = "my + " + " + ".join(f"w{i} * ({c} - m{i})" for i, c in enumerate(features))
    return (f"SELECT symbol, ts, {tag}{rnd(pred, 4)} AS prediction "
            f"FROM {src}, ({sql_ridge_weights(features, label, alpha, src)}) fit")


def q_coef_select(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    keep = M.select_by_coefficient(bars, FEATS + ["volume"], "close")
    return spark.createDataFrame([(f,) for f in keep], "feature string")


def sql_coef_select():
    cols = FEATS + ["volume"]
    pairs = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(w{i}) AS w FROM fit" for i, c in enumerate(cols))
    return (f"WITH fit AS MATERIALIZED ({sql_ridge_weights(cols, 'close', 1.0, f'{LB} q')}), p AS ({pairs}) "
            "SELECT feature FROM p WHERE w >= (SELECT avg(w) FROM p)")


FOREST_SPACE = {"numTrees": ("int", 4, 12), "maxDepth": ("int", 2, 6), "minInstancesPerNode": [1, 5]}


def q_forest(spark, sf_dir):
    """Tuned forest: predictions of the rows after the train part, then its importances."""
    done = M.tuned_forest(line_bars(spark, sf_dir), FEATS, "close", FOREST_SPACE, n_trials=4, folds=2, startup=3)
    pred = done.predictions.select(F.lit("prediction").alias("part"), "symbol", "ts", F.col("close").alias("actual"),
                                   "prediction", F.lit(None).cast("string").alias("feature"),
                                   F.lit(None).cast("double").alias("importance"))
    return pred.unionByName(done.importances.withColumn("part", F.lit("importance")), allowMissingColumns=True)


def _trials(spark, sf_dir):
    """The reference's study: a hundred trials on five folds, the first ten drawn by chance."""
    return M.hyperparameter_search(line_bars(spark, sf_dir), FEATS, "close", FOREST_SPACE, n_trials=100, folds=5,
                                   parallelism=5, ts="ts", startup=10)


def q_search(spark, sf_dir):
    return _trials(spark, sf_dir)


SMA_GRID = [2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610]


def q_trial_report(spark, sf_dir):
    """Report over a grid search of the moving-average forecast window (the
    largest window exceeds the series at small scales and scores inf, a failed trial)."""
    trials = M.trial_table(M.sma_window_search(line_bars(spark, sf_dir), SMA_GRID), SMA_GRID)
    rep = M.trial_report(trials)
    return rep.select("n_trials", "n_complete", F.col("best.number").alias("best_number"),
                      F.col("best.params_window").alias("best_window"),
                      spark_round("best.value", 4).alias("best_value"))


def sql_trial_report():
    preds = ", ".join(f"avg(close) OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS p{n}, "
                      f"count(close) OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS c{n}"
                      for n in SMA_GRID)
    trials = " UNION ALL ".join(
        f"SELECT {i} AS number, {n} AS w, avg(CASE WHEN c{n} = {n} THEN (close - p{n}) * "
        f"(close - p{n}) END) AS mse FROM f" for i, n in enumerate(SMA_GRID))
    return f"""
WITH f AS (SELECT close, {preds} FROM {LB} q),
t AS ({trials}),
v AS (SELECT number, w, coalesce(mse, 'inf'::DOUBLE) AS value FROM t)
SELECT CAST(count(*) AS BIGINT) AS n_trials,
       CAST(count(*) FILTER (WHERE value <> 'inf'::DOUBLE) AS BIGINT) AS n_complete,
       arg_min(number, value) FILTER (WHERE value <> 'inf'::DOUBLE) AS best_number,
       arg_min(w, value) FILTER (WHERE value <> 'inf'::DOUBLE) AS best_window,
       {rnd("min(value) FILTER (WHERE value <> 'inf'::DOUBLE)", 4)} AS best_value FROM v"""


# open and volume only: on nearly collinear prices two correct solvers differ in the printed digits
SCORED = ["open", "volume"]


def q_batch_score(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    paths = {}
    for name, alpha in (("ridge_1", 1.0), ("ridge_10", 10.0)):
        path = scratch_path(spark, name)
        M.fit_ridge(bars, SCORED, "close", alpha).write().save(path)
        paths[name] = path
    out = M.batch_score(bars, paths)
    return out.select("symbol", "ts", "model", spark_round("prediction", 4).alias("prediction"))


def sql_batch_score():
    return " UNION ALL ".join(
        f"SELECT * FROM ({sql_ridge(SCORED, 'close', alpha, f'{LB} q', f"""'{name}' AS model, """)}) s_{name}"
        for name, alpha in (("ridge_1", 1.0), ("ridge_10", 10.0)))


def q_per_symbol(spark, sf_dir):
    """Two features a symbol; its threshold is half the variance of its close."""
    bars = line_bars(spark, sf_dir)
    limits = bars.groupBy("symbol").agg((F.var_pop("close") * 0.5).alias("threshold"))
    out = M.train_per_symbol(bars, ["open", "volume"], "close", limits)
    out = out.withColumn("mse", spark_round("mse", 1))  # about 1e8: more digits are those of the order of summing
    return _r(out, ["symbol", "accepted", "mse"], ["intercept", "coef_open", "coef_volume"], 3)


SQL_PER_SYMBOL = f"""
WITH b AS MATERIALIZED (SELECT * FROM {LB} q),
g AS (SELECT symbol, var_pop(open) AS xx, covar_pop(open, volume) AS xz, var_pop(volume) AS zz,
             covar_pop(open, close) AS xy, covar_pop(volume, close) AS zy, avg(open) AS mx, avg(volume) AS mz,
             avg(close) AS my, var_pop(close) AS yy FROM b GROUP BY symbol),
w AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS p, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS q FROM g),
m AS (SELECT symbol, avg((close - my - p * (open - mx) - q * (volume - mz)) * (close - my - p * (open - mx)
             - q * (volume - mz))) AS mse FROM b JOIN w USING (symbol) GROUP BY symbol)
SELECT symbol, mse <= 0.5 * yy AS accepted, {rnd('my - p * mx - q * mz', 3)} AS intercept, {rnd('p', 3)} AS coef_open,
       {rnd('q', 3)} AS coef_volume, {rnd('mse', 1)} AS mse FROM w JOIN m USING (symbol)"""


def q_metrics(spark, sf_dir):
    m = M.regression_metrics(_naive(spark, sf_dir).where(F.col("predicted").isNotNull()),
                             "close", "predicted")
    return _r(m, ["symbol", "n"], ["mse", "rmse", "mae", "mape", "r2"], 4)


SQL_METRICS = f"""
WITH b AS (SELECT symbol, close, lag(close) OVER ({P}) AS p FROM {LB} q),
e AS (SELECT symbol, close, close - p AS e FROM b WHERE p IS NOT NULL)
SELECT symbol, count(e) AS n, {rnd('avg(e * e)', 4)} AS mse, {rnd('sqrt(avg(e * e))', 4)} AS rmse,
       {rnd('avg(abs(e))', 4)} AS mae, {rnd(f"avg(abs({tdiv('e', 'close')}))", 4)} AS mape,
       {rnd(f"1 - {tdiv('sum(e * e)', 'var_pop(close) * count(e)')}", 4)} AS r2
FROM e GROUP BY symbol"""


def q_cv_summary(spark, sf_dir):
    folds = FE.kfold(_naive(spark, sf_dir), 5)
    long = (folds.select("fold", F.lit("lag_1").alias("model"),
                         ((F.col("close") - F.col("predicted")) ** 2).alias("se"))
            .unionByName(folds.select("fold", F.lit("lag_5").alias("model"),
                                      ((F.col("close") - F.col("pred5")) ** 2).alias("se"))))
    per_fold = long.groupBy("model", "fold").agg(F.avg("se").alias("mse"))
    out = per_fold.groupBy("model").agg(F.avg("mse").alias("mean_mse"),
                                        F.stddev_pop("mse").alias("std_mse"))
    return _r(out, ["model"], ["mean_mse", "std_mse"], 4)


SQL_CV = f"""
WITH b AS (SELECT close, lag(close) OVER ({P}) AS p1, lag(close, 5) OVER ({P}) AS p5,
       CAST(floor((row_number() OVER ({P}) - 1) * 5 / count(*) OVER (PARTITION BY symbol)) AS INTEGER)
       AS fold FROM {LB} q),
l AS (SELECT fold, 'lag_1' AS model, (close - p1) * (close - p1) AS se FROM b
      UNION ALL SELECT fold, 'lag_5', (close - p5) * (close - p5) FROM b),
f AS (SELECT model, fold, avg(se) AS mse FROM l GROUP BY model, fold)
SELECT model, {rnd('avg(mse)', 4)} AS mean_mse, {rnd('stddev_pop(mse)', 4)} AS std_mse
FROM f GROUP BY model"""

CLASSES = ["down", "flat", "up"]


def _cls(x):
    return F.when(x > 0, "up").when(x < 0, "down").when(x == 0, "flat")


def q_confusion(spark, sf_dir):
    n = _naive(spark, sf_dir)
    lab = n.select(_cls(F.col("close") - F.col("predicted")).alias("actual"),
                   _cls(F.col("predicted") - F.col("prev2")).alias("pred")).na.drop()
    counts = lab.groupBy("actual").pivot("pred", CLASSES).count()
    classes = spark.createDataFrame([(c,) for c in CLASSES], "actual string")
    return classes.join(counts, "actual", "left").na.fill(0, CLASSES).select(
        "actual", *[F.col(c).cast("bigint").alias(c) for c in CLASSES])


SQL_CONFUSION = f"""
WITH b AS (SELECT close, lag(close) OVER ({P}) AS p1, lag(close, 2) OVER ({P}) AS p2 FROM {LB} q),
l AS (SELECT CASE WHEN close - p1 > 0 THEN 'up' WHEN close - p1 < 0 THEN 'down' WHEN close - p1 = 0
             THEN 'flat' END AS actual,
             CASE WHEN p1 - p2 > 0 THEN 'up' WHEN p1 - p2 < 0 THEN 'down' WHEN p1 - p2 = 0
             THEN 'flat' END AS pred FROM b),
c AS (SELECT * FROM (VALUES ('down'), ('flat'), ('up')) t(actual))
SELECT c.actual, {', '.join(f"count(l.pred) FILTER (WHERE l.pred = '{k}') AS {k}" for k in CLASSES)}
FROM c LEFT JOIN (SELECT * FROM l WHERE actual IS NOT NULL AND pred IS NOT NULL) l
  ON c.actual = l.actual GROUP BY c.actual"""


def q_residuals(spark, sf_dir):
    n = _naive(spark, sf_dir).where(F.col("predicted").isNotNull()).withColumn(
        "e", F.col("close") - F.col("predicted"))
    st = n.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    b = F.least(F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10) + 1,
                F.lit(10)).cast("int")
    return with_scalars(n, st).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


SQL_RESIDUALS = f"""
WITH b AS (SELECT close - lag(close) OVER ({P}) AS e FROM {LB} q),
r AS (SELECT e, min(e) OVER () AS lo, max(e) OVER () AS hi FROM b WHERE e IS NOT NULL)
SELECT CAST(least(floor((e - lo) / (hi - lo) * 10) + 1, 10) AS INTEGER) AS bucket, count(*) AS n
FROM r GROUP BY 1"""


def q_contributions(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    coefs = M.per_symbol_ols(bars, ["open"], "close")
    means = bars.groupBy("symbol").agg(F.avg("open").alias("_mu"))
    n_sym = key_count(bars, "symbol")  # both tables hold one row per symbol
    out = (bars.join(maybe_broadcast(coefs, n_sym), "symbol")
           .join(maybe_broadcast(means, n_sym), "symbol")
           .withColumn("contrib_open", F.col("coef_open") * (F.col("open") - F.col("_mu"))))
    return _r(out, ["symbol", "ts"], ["contrib_open"], 4)


SQL_CONTRIB = (f"SELECT symbol, ts, {rnd('regr_slope(close, open) OVER (PARTITION BY symbol) * '
               '(open - avg(open) OVER (PARTITION BY symbol))', 4)} AS contrib_open FROM {LB} b")


def q_exemplars(spark, sf_dir):
    n = stored(_naive(spark, sf_dir).where(F.col("predicted").isNotNull())
               .withColumn("e", F.col("close") - F.col("predicted")), "residuals")
    q = quantiles(n, "e", [0.25, 0.5, 0.75], by=["symbol"], names=["q1", "q2", "q3"])
    scaled = ["predicted", "open", "high", "low"]
    st = (n.groupBy("symbol").agg(F.stddev_pop("e").alias("sd"),
                                  *[F.min(c).alias(f"mn_{c}") for c in scaled],
                                  *[F.max(c).alias(f"mx_{c}") for c in scaled])
          .join(q, "symbol")
          .select("symbol", "sd", F.array("q1", "q2", "q3").alias("q"),
                  *[f"mn_{c}" for c in scaled], *[f"mx_{c}" for c in scaled]))
    x = n.join(st, "symbol")

    def unit(c):  # min-max scaled per symbol (null on a constant column)
        return F.try_divide(F.col(c) - F.col(f"mn_{c}"), F.col(f"mx_{c}") - F.col(f"mn_{c}"))

    boundary = (unit("predicted") < 0.05) | (unit("predicted") > 0.95)
    extreme = F.lit(False)
    for c in ("open", "high", "low"):
        extreme = extreme | F.coalesce((unit(c) < 0.01) | (unit(c) > 0.99), F.lit(False))
    scores = {
        "worst": -F.abs("e"),
        "best": F.abs("e"),
        "median": F.abs(F.col("e") - F.col("q")[1]),
        "q25": F.abs(F.col("e") - F.col("q")[0]),
        "q75": F.abs(F.col("e") - F.col("q")[2]),
        "outlier": F.when(F.abs("e") > 3 * F.col("sd"), F.lit(0.0)).otherwise(1e300 - F.abs("e")),
        # first row with a prediction at the edge of its range, else the worst
        "boundary_case": F.when(F.coalesce(boundary, F.lit(False)), F.lit(0.0)).otherwise(1e300 - F.abs("e")),
        # first row with any feature at the edge of its range, else the worst
        "feature_extreme": F.when(extreme, F.lit(0.0)).otherwise(1e300 - F.abs("e")),
    }
    # lowest score, earliest ts on ties: one aggregate over the rows as they are, not over a copy for each strategy
    best = x.groupBy("symbol").agg(F.array(*[
        F.struct(F.lit(name).alias("strategy"), F.min_by(F.col("ts"), F.struct(score.alias("score"), F.col("ts"))).alias("ts"))
        for name, score in scores.items()]).alias("_best"))
    return best.select("symbol", F.inline("_best"))


SQL_EXEMPLARS = f"""
WITH n AS (SELECT symbol, ts, open, high, low, lag(close) OVER ({P}) AS predicted,
                  close - lag(close) OVER ({P}) AS e FROM {LB} q),
x0 AS (SELECT * FROM n WHERE e IS NOT NULL),
x AS (SELECT *, quantile_cont(e, 0.25) OVER (PARTITION BY symbol) AS q1,
             quantile_cont(e, 0.5) OVER (PARTITION BY symbol) AS q2,
             quantile_cont(e, 0.75) OVER (PARTITION BY symbol) AS q3,
             stddev_pop(e) OVER (PARTITION BY symbol) AS sd, (CASE WHEN max(predicted) OVER (PARTITION BY symbol) - min(predicted) OVER (PARTITION BY symbol) = 0 THEN NULL ELSE (predicted - min(predicted) OVER (PARTITION BY symbol)) / (max(predicted) OVER (PARTITION BY symbol) - min(predicted) OVER (PARTITION BY symbol)) END) AS u_p, (CASE WHEN max(open) OVER (PARTITION BY symbol) - min(open) OVER (PARTITION BY symbol) = 0 THEN NULL ELSE (open - min(open) OVER (PARTITION BY symbol)) / (max(open) OVER (PARTITION BY symbol) - min(open) OVER (PARTITION BY symbol)) END) AS u_o, (CASE WHEN max(high) OVER (PARTITION BY symbol) - min(high) OVER (PARTITION BY symbol) = 0 THEN NULL ELSE (high - min(high) OVER (PARTITION BY symbol)) / (max(high) OVER (PARTITION BY symbol) - min(high) OVER (PARTITION BY symbol)) END) AS u_h, (CASE WHEN max(low) OVER (PARTITION BY symbol) - min(low) OVER (PARTITION BY symbol) = 0 THEN NULL ELSE (low - min(low) OVER (PARTITION BY symbol)) / (max(low) OVER (PARTITION BY symbol) - min(low) OVER (PARTITION BY symbol)) END) AS u_l FROM x0),
c AS (SELECT symbol, ts, 'worst' AS strategy, -abs(e) AS score FROM x
      UNION ALL SELECT symbol, ts, 'best', abs(e) FROM x
      UNION ALL SELECT symbol, ts, 'median', abs(e - q2) FROM x
      UNION ALL SELECT symbol, ts, 'q25', abs(e - q1) FROM x
      UNION ALL SELECT symbol, ts, 'q75', abs(e - q3) FROM x
      UNION ALL SELECT symbol, ts, 'outlier', CASE WHEN abs(e) > 3 * sd THEN 0.0
                                              ELSE 1e300 - abs(e) END FROM x
      UNION ALL SELECT symbol, ts, 'boundary_case', CASE WHEN coalesce(u_p < 0.05 OR u_p > 0.95,
                                              false) THEN 0.0 ELSE 1e300 - abs(e) END FROM x
      UNION ALL SELECT symbol, ts, 'feature_extreme', CASE WHEN
          coalesce(u_o < 0.01 OR u_o > 0.99, false) OR coalesce(u_h < 0.01 OR u_h > 0.99, false)
          OR coalesce(u_l < 0.01 OR u_l > 0.99, false) THEN 0.0 ELSE 1e300 - abs(e) END FROM x)
SELECT symbol, strategy, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol, strategy
  ORDER BY score, ts) AS k FROM c) r WHERE k = 1"""


def q_novelty(spark, sf_dir):
    s = stored(FE.split_chronological(line_bars(spark, sf_dir), 0.8).select("symbol", "ts", "close", "split"), "novelty-split")
    out = M.novelty_exemplar(s.where(F.col("split") == "train"),
                             s.where(F.col("split") == "test"), "close")
    return _r(out, ["symbol", "ts"], ["dist"])


SQL_NOVELTY = f"""
WITH b AS (SELECT symbol, ts, close, CASE WHEN row_number() OVER ({P}) <= floor(count(*) OVER
           (PARTITION BY symbol) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {LB} q),
d AS (SELECT *, least(close - last_value(CASE WHEN split = 'train' THEN close END IGNORE NULLS) OVER
        (PARTITION BY symbol ORDER BY close, ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(CASE WHEN split = 'train' THEN close END IGNORE NULLS) OVER (PARTITION BY symbol
        ORDER BY close, ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - close) AS dist FROM b)
SELECT symbol, ts, {rnd('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY symbol
  ORDER BY dist DESC NULLS LAST, ts) AS k FROM d WHERE split = 'test') r WHERE k = 1"""


def q_clusters(spark, sf_dir):
    n = _naive(spark, sf_dir).withColumn("e", F.col("close") - F.col("predicted"))
    return M.cluster_exemplars(n, ["open", "close"], "e", 5)[0]


def q_walk_forward(spark, sf_dir):
    out = walk_forward(line_bars(spark, sf_dir), threshold=0.9)
    return _r(out, ["symbol", "ts", "differenced", "accepted"], ["actual", "predicted", "mse"], 4)


SQL_WALK_FORWARD = f"""
WITH b AS MATERIALIZED (SELECT symbol, ts, close, lag(close) OVER ({P}) AS pc,
       row_number() OVER ({P}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS train FROM {LB} q),
g AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS sd, regr_slope(close - pc, pc) AS sl,
             regr_sxx(close - pc, pc) AS sxx, regr_syy(close - pc, pc) AS syy, regr_count(close - pc, pc) AS n
      FROM b WHERE train GROUP BY symbol),
t AS MATERIALIZED (SELECT symbol, m, CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS s,
             coalesce(CASE WHEN n > 2 THEN {tdiv('sl', 'sqrt(greatest(syy - sl * sl * sxx, 0.0) / (n - 2) / sxx)')} END
                      < -2.86, false) AS steady FROM g),
z AS (SELECT symbol, ts, close, train, m, s, steady, (close - m) / s AS z, (pc - m) / s AS z1 FROM b JOIN t USING (symbol)),
x AS (SELECT *, CASE WHEN steady THEN z ELSE z - z1 END AS x FROM z),
x1 AS MATERIALIZED (SELECT *, lag(x) OVER ({P}) AS x1 FROM x),
r AS (SELECT *, regr_slope(x, x1) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb,
             regr_intercept(x, x1) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sa,
             regr_count(x, x1) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM x1),
p AS (SELECT *, sa + sb * x1 + CASE WHEN steady THEN 0.0 ELSE z1 END AS zh FROM r WHERE k >= 2),
o AS (SELECT *, avg((z - zh) * (z - zh)) OVER (PARTITION BY symbol) AS mse FROM p WHERE NOT train AND zh IS NOT NULL
      AND isfinite(zh))
SELECT symbol, ts, NOT steady AS differenced, mse <= 0.9 AS accepted, {rnd('close', 4)} AS actual,
       {rnd('m + s * zh', 4)} AS predicted, {rnd('mse', 4)} AS mse FROM o"""


def q_stationarity(spark, sf_dir):
    def build(df, carries):
        return df.withColumns({"dy": F.col("close") - K.lag("close", 1, "symbol"),
                               "y1": K.lag("close", 1, "symbol")})
    d = run_series(line_bars(spark, sf_dir), build, halo=1).na.drop(subset=["dy", "y1"])
    g = d.groupBy("symbol").agg(F.regr_slope("dy", "y1").alias("slope"),
                                F.regr_sxx("dy", "y1").alias("sxx"),
                                F.regr_syy("dy", "y1").alias("syy"),
                                F.regr_count("dy", "y1").alias("n"))
    se = F.sqrt((F.col("syy") - F.col("slope") ** 2 * F.col("sxx")) / (F.col("n") - 2)
                / F.col("sxx"))
    out = g.withColumn("tau", F.try_divide(F.col("slope"), se))
    return _r(out.withColumn("stationary", F.col("tau") < -2.86), ["symbol", "stationary"],
              ["tau"], 4)


SQL_STATIONARITY = f"""
WITH d AS (SELECT symbol, close - lag(close) OVER ({P}) AS dy, lag(close) OVER ({P}) AS y1 FROM {LB} q),
g AS (SELECT symbol, regr_slope(dy, y1) AS slope, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy,
             regr_count(dy, y1) AS n FROM d WHERE dy IS NOT NULL AND y1 IS NOT NULL GROUP BY symbol),
t AS (SELECT symbol, {tdiv('slope', 'sqrt((syy - slope * slope * sxx) / (n - 2) / sxx)')} AS tau FROM g)
SELECT symbol, tau < -2.86 AS stationary, {rnd('tau', 4)} AS tau FROM t"""


# ------------------------------------------------------------------ §2.11
def _sized_ledger(spark, sf_dir):
    """The replay, the rows of its longest series and of all: those of the bars."""
    bars = line_bars(spark, sf_dir, columns=["symbol", "ts", "close"]).na.drop(subset=["symbol", "ts"])
    largest, total = series_sizes(bars)
    return BT.action_ledger(BT.momentum_actions(bars, largest=largest, total=total), largest=largest), largest, total


def _ledger(spark, sf_dir):
    return _sized_ledger(spark, sf_dir)[0]


def q_ledger(spark, sf_dir):
    return _r(_ledger(spark, sf_dir), ["symbol", "ts", "action_type", "negative_balance"],
              ["balance", "shares", "equity"], REC_DIGITS)


def q_reward(spark, sf_dir):
    return _r(_ledger(spark, sf_dir), ["symbol", "ts"], ["reward"], REC_DIGITS)


def _sql_ledger_cte():
    # an action trades at its own bar's price and is valued at the next bar (the last one at its own)
    act = (f"SELECT *, action_type AS act, "
           f"coalesce(lead(price) OVER ({P}), price) AS next_price FROM ("
           f"SELECT symbol, ts, row_number() OVER ({P}) AS rn, close AS price, CASE WHEN close - "
           f"lag(close) OVER ({P}) > 0 THEN 0 WHEN close - lag(close) OVER ({P}) < 0 THEN 1 ELSE 2 "
           f"END AS action_type FROM {LB} q) t")
    bal = ("CASE WHEN b.act = 0 AND b.price > 0 THEN p.bal - floor(p.bal / b.price) * 0.5 * "
           "b.price * 1.001 WHEN b.act = 1 THEN p.bal + p.sh * 0.5 * b.price * 0.999 "
           "ELSE p.bal END")
    sh = ("CASE WHEN b.act = 0 AND b.price > 0 THEN p.sh + floor(p.bal / b.price) * 0.5 "
          "WHEN b.act = 1 THEN p.sh - p.sh * 0.5 ELSE p.sh END")
    init_bal = ("CASE WHEN act = 0 AND price > 0 THEN 10000.0 - floor(10000.0 / price) * "
                "0.5 * price * 1.001 ELSE 10000.0 END")
    init_sh = "CASE WHEN act = 0 AND price > 0 THEN floor(10000.0 / price) * 0.5 ELSE 0.0 END"
    rec = _recursive("l", "a", {"bal": f"CAST({init_bal} AS DOUBLE)", "sh": f"CAST({init_sh} AS DOUBLE)"},
                     {"bal": bal, "sh": sh})
    return f"WITH RECURSIVE a AS MATERIALIZED ({act}),\n{rec}"


def sql_ledger():
    return (_sql_ledger_cte() + f"""
SELECT a.symbol, a.ts, a.action_type, l.bal < 0 AS negative_balance, {rnd('l.bal', 4)} AS balance,
       {rnd('l.sh', 4)} AS shares, {rnd('l.sh * a.next_price + l.bal', 4)} AS equity
FROM l JOIN a USING (symbol, rn)""")


def sql_reward():
    return (_sql_ledger_cte() + f"""
SELECT a.symbol, a.ts, {rnd('l.sh * a.next_price + l.bal - 10000.0', 4)} AS reward
FROM l JOIN a USING (symbol, rn)""")


def _perf(spark, sf_dir):
    return BT.performance(line_bars(spark, sf_dir), "close")


def _q_perf(cols, digits=6):
    def run(spark, sf_dir):
        return _r(_perf(spark, sf_dir), ["symbol"], cols, digits)
    return run


PERF_BASE = f"""
WITH b AS (SELECT symbol, ts, close, {tdiv(f'close - lag(close) OVER ({P})', f'lag(close) OVER ({P})')}
           AS ret, max(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
           FROM {LB} q),
x AS (SELECT *, ret - {BT.RF / BT.TRADING_DAYS} AS ex FROM b)"""

_PERF_EXPR = {
    "sharpe_ratio": f"avg(ex) / stddev_pop(ex) * {math.sqrt(BT.TRADING_DAYS)}",
    "sortino_ratio": f"avg(ex) / stddev_pop(CASE WHEN ex < 0 THEN ex END) * {math.sqrt(BT.TRADING_DAYS)}",
    "max_drawdown": f"max({tdiv('peak - close', 'peak')})",
    "average_return": "avg(ret)",
    "max_drawdown_abs": "max(peak - close)",
    "volatility": "stddev_pop(ret)",
    "mfe": "max(close) - arg_min(close, ts)",
    "mae": "arg_min(close, ts) - min(close)",
}


def _sql_perf(cols, digits=6):
    return (PERF_BASE + "\nSELECT symbol, " + ", ".join(f"{rnd(_PERF_EXPR[c], digits)} AS {c}"
                                                        for c in cols)
            + " FROM x GROUP BY symbol")


_REPORT = ["total_reward", "final_balance", "final_equity", "mfe", "mae", "sharpe_ratio", "sortino_ratio", "max_drawdown"]


def q_backtest_report(spark, sf_dir):
    """Summary and step arrays written as JSON, read back and joined: one row for each part of a symbol's steps."""
    ledger, largest, total = _sized_ledger(spark, sf_dir)
    summary, steps = BT.backtest_report(ledger, largest=largest, total=total)
    back = []
    for name, df in (("report", summary), ("report-steps", steps)):
        path = scratch_path(spark, name)
        df.write.mode("errorifexists").json(path)
        back.append(spark.read.schema(df.schema).json(path))
    listed = back[1].join(maybe_broadcast(back[0], back[0].count()), "symbol")
    cents = {c: F.array_join(F.transform(c, lambda x: F.floor(x * 100 + 0.5000001).cast("long").cast("string")), ",")
             for c in ("step_rewards", "step_prices")}
    return _r(listed.withColumns(cents), ["symbol", "steps", "part", *cents], _REPORT, 4)


def sql_backtest_report():
    cents = "string_agg(CAST(floor({} * 100 + 0.5000001) AS BIGINT), ',' ORDER BY rn)"
    return _sql_ledger_cte() + f""",
e AS (SELECT a.symbol, a.rn, a.next_price AS price, l.bal, l.sh * a.next_price + l.bal AS equity FROM l JOIN a USING (symbol, rn)),
c AS (SELECT *, sum(equity - 10000.0) OVER (PARTITION BY symbol ORDER BY rn) AS total,
             max(price) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM e),
x AS (SELECT *, {tdiv('total - lag(total) OVER w', 'lag(total) OVER w')} - {BT.RF / BT.TRADING_DAYS} AS ex
      FROM c WINDOW w AS (PARTITION BY symbol ORDER BY rn))
SELECT symbol, count(*) AS steps, (rn - 1) // {BT.REPORT_STEPS} AS part,
       {cents.format('total')} AS step_rewards, {cents.format('price')} AS step_prices,
       {rnd('arg_max(total, rn)', 4)} AS total_reward, {rnd('arg_max(bal, rn)', 4)} AS final_balance,
       {rnd('arg_max(equity, rn)', 4)} AS final_equity,
       {rnd('max(price) - arg_min(price, rn)', 4)} AS mfe, {rnd('arg_min(price, rn) - min(price)', 4)} AS mae,
       {rnd(_PERF_EXPR['sharpe_ratio'], 4)} AS sharpe_ratio, {rnd(_PERF_EXPR['sortino_ratio'], 4)} AS sortino_ratio,
       {rnd('max((peak - price) / peak)', 4)} AS max_drawdown
FROM x GROUP BY symbol, part"""


RISK_SQL = f"""
WITH b AS (SELECT symbol, ts, close,
      max(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_water,
      min(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low_water,
      first_value(close) OVER ({P}) AS initial FROM {LB} q),
s AS (SELECT *, {tdiv('high_water - close', 'high_water')} AS dd,
             {tdiv('close - initial', 'initial')} AS profit FROM b),
r AS (SELECT *, CASE WHEN dd > 0.2 THEN 'STOP_TRADING' WHEN dd >= 0.05 THEN 'STOP_LOSS'
             WHEN profit >= 0.1 THEN 'TAKE_PROFIT' ELSE 'CONTINUE_TRADING' END AS status FROM s)"""


def _risk(spark, sf_dir):
    return BT.risk_status(line_bars(spark, sf_dir), "close")


def q_risk_status(spark, sf_dir):
    return _r(_risk(spark, sf_dir), ["symbol", "ts", "status"],
              ["high_water", "low_water", "drawdown", "profit"])


SQL_RISK_STATUS = RISK_SQL + f"""
SELECT symbol, ts, status, {rnd('high_water')} AS high_water, {rnd('low_water')} AS low_water,
       {rnd('dd')} AS drawdown, {rnd('profit')} AS profit FROM r"""


def q_risk_truncate(spark, sf_dir):
    """Episodes of the ledger's equity; a stop or a taken profit sells everything."""
    out = BT.risk_truncate(BT.risk_status(_ledger(spark, sf_dir), "equity"))
    return _r(out, ["symbol", "ts", "status"], ["balance", "shares", "equity"], 4)


def sql_risk_truncate():
    upto = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sells = "r.ts = st.stop AND r.status IN ('STOP_LOSS', 'TAKE_PROFIT')"
    cash = f"r.bal + (r.eq - r.bal) * {1 - BT.FEE}"
    return _sql_ledger_cte() + f""",
e AS (SELECT a.symbol, a.ts, l.bal, l.sh, l.sh * a.next_price + l.bal AS eq FROM l JOIN a USING (symbol, rn)),
w AS (SELECT *, max(eq) {upto} AS hw, first_value(eq) OVER ({P}) AS initial FROM e),
s AS (SELECT *, {tdiv('hw - eq', 'hw')} AS dd, {tdiv('eq - initial', 'initial')} AS profit FROM w),
r AS (SELECT *, CASE WHEN dd > 0.2 THEN 'STOP_TRADING' WHEN dd >= 0.05 THEN 'STOP_LOSS'
             WHEN profit >= 0.1 THEN 'TAKE_PROFIT' ELSE 'CONTINUE_TRADING' END AS status FROM s),
st AS (SELECT symbol, min(ts) AS stop FROM r WHERE status <> 'CONTINUE_TRADING' GROUP BY symbol)
SELECT r.symbol, r.ts, r.status, {rnd(f'CASE WHEN {sells} THEN {cash} ELSE r.bal END', 4)} AS balance,
       {rnd(f'CASE WHEN {sells} THEN 0.0 ELSE r.sh END', 4)} AS shares,
       {rnd(f'CASE WHEN {sells} THEN {cash} ELSE r.eq END', 4)} AS equity
FROM r LEFT JOIN st USING (symbol) WHERE st.stop IS NULL OR r.ts <= st.stop"""


def q_risk_parameters(spark, sf_dir):
    """A day's limits from the spread and the mean of its hourly returns."""
    def build(df, carries):
        p = K.lag("close", 1, "symbol")
        return df.withColumn("ret", F.try_divide(F.col("close") - p, p))
    r = run_series(event_bars(spark, sf_dir), build, halo=1)
    cond = (r.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
            .agg((F.stddev_pop("ret") * math.sqrt(252)).alias("volatility"),
                 (F.avg("ret") * 252).alias("trend")))
    out = BT.risk_parameters(cond)
    return _r(out, ["symbol", "day"], ["max_drawdown", "stop_loss", "take_profit"])


SQL_RISK_PARAMS = f"""
WITH b AS (SELECT symbol, ts, {tdiv(f'close - lag(close) OVER ({P})', f'lag(close) OVER ({P})')} AS ret
           FROM ({EVENT_BARS_SQL}) q),
c AS (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
             stddev_pop(ret) * {math.sqrt(252)} AS v, avg(ret) * 252 AS t FROM b GROUP BY 1, 2)
SELECT symbol, day, {rnd('least(greatest(0.2 * coalesce(v, 0.1), 0.1), 0.3)')} AS max_drawdown,
       {rnd('least(greatest(0.05 * coalesce(t, 0.1), 0.02), 0.1)')} AS stop_loss,
       {rnd('least(greatest(0.1 * coalesce(t, 0.1), 0.05), 0.2)')} AS take_profit FROM c"""


def q_risk_optimize(spark, sf_dir):
    idx = FE.with_row_index(line_bars(spark, sf_dir))
    g = idx.groupBy("symbol").agg(
        F.regr_slope("close", F.col("rn") - 1).alias("trend"))
    out = BT.risk_parameters(g.withColumn("volatility", F.col("trend")))
    return _r(out, ["symbol"], ["max_drawdown", "stop_loss", "take_profit"])


SQL_RISK_OPT = f"""
WITH b AS (SELECT symbol, close, row_number() OVER ({P}) - 1 AS x FROM {LB} q),
g AS (SELECT symbol, regr_slope(close, x) AS t FROM b GROUP BY symbol)
SELECT symbol, {rnd('least(greatest(0.2 * coalesce(t, 0.1), 0.1), 0.3)')} AS max_drawdown,
       {rnd('least(greatest(0.05 * coalesce(t, 0.1), 0.02), 0.1)')} AS stop_loss,
       {rnd('least(greatest(0.1 * coalesce(t, 0.1), 0.05), 0.2)')} AS take_profit FROM g"""


def _options(spark, sf_dir):
    return BT.option_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))


def q_contract_pnl(spark, sf_dir):
    c = BT.option_contract_pnl(_options(spark, sf_dir))
    out = c.groupBy("order_id", "option_id").agg(F.count(F.lit(1)).alias("contracts"),
                                                 F.sum("pnl").alias("pnl"))
    return _r(out, ["order_id", "option_id", "contracts"], ["pnl"])


LEGS_SQL = """(SELECT o_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS option_id,
        o_totalprice / 10000 AS order_price, l_extendedprice / l_quantity / 100 AS leg_price,
        l_quantity AS q, sum(l_quantity) OVER (PARTITION BY o_orderkey) AS cq
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')"""

SQL_CONTRACT_PNL = f"""
SELECT order_id, option_id, count(*) AS contracts, {rnd('sum(order_price - leg_price)')} AS pnl
FROM {LEGS_SQL} g, range(1, CAST(floor(q) AS BIGINT) + 1) t(i) GROUP BY order_id, option_id"""


def q_trade_pnl(spark, sf_dir):
    return _r(BT.option_trade_pnl(_options(spark, sf_dir)), ["order_id", "option_id"], ["pnl"])


SQL_TRADE_PNL = f"SELECT order_id, option_id, {rnd('cq * (order_price - leg_price)')} AS pnl FROM {LEGS_SQL} g"


def q_trade_summary(spark, sf_dir):
    s = BT.trade_summary(BT.option_trade_pnl(_options(spark, sf_dir)))
    return _r(s, ["wins", "losses"], ["accuracy", "average_profit", "average_loss", "total_profit",
                                      "total_loss"], 2)


SQL_TRADE_SUMMARY = f"""
WITH p AS (SELECT cq * (order_price - leg_price) AS pnl FROM {LEGS_SQL} g)
SELECT count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses,
  {rnd('coalesce(count(*) FILTER (WHERE pnl > 0) * 100.0 / nullif(count(pnl), 0), 0.0)', 2)} AS accuracy,
  {rnd('coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0.0)', 2)} AS average_profit,
  {rnd('coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0.0)', 2)} AS average_loss,
  {rnd('coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0.0)', 2)} AS total_profit,
  {rnd('coalesce(sum(pnl) FILTER (WHERE pnl <= 0), 0.0)', 2)} AS total_loss FROM p"""


def catalog():
    return {
        "ridge_regression": (q_ridge, sql_ridge(FEATS, "close", 1.0, f"{LB} q")),
        "coef_feature_selection": (q_coef_select, sql_coef_select()),
        "random_forest_regression": (q_forest, None),
        "hyperparameter_search": (q_search, None),
        "trial_report": (q_trial_report, sql_trial_report()),
        # rows-only: open/high/low are nearly collinear, so the alpha=10 model's
        # solution differs between solvers in the 9th significant digit
        "batch_score": (q_batch_score, sql_batch_score()),
        "train_per_symbol": (q_per_symbol, SQL_PER_SYMBOL),
        "regression_metrics": (q_metrics, SQL_METRICS),
        "cv_summary": (q_cv_summary, SQL_CV),
        "confusion_matrix": (q_confusion, SQL_CONFUSION),
        "residuals": (q_residuals, SQL_RESIDUALS),
        "linear_contributions": (q_contributions, SQL_CONTRIB),
        "residual_exemplars": (q_exemplars, SQL_EXEMPLARS),
        "exemplar_novelty": (q_novelty, SQL_NOVELTY),
        "exemplar_clusters": (q_clusters, None),
        "walk_forward_forecast": (q_walk_forward, SQL_WALK_FORWARD),
        "stationarity_test": (q_stationarity, SQL_STATIONARITY),
        "action_ledger": (q_ledger, sql_ledger()),
        "step_reward": (q_reward, sql_reward()),
        "mfe_mae": (_q_perf(["mfe", "mae"]), _sql_perf(["mfe", "mae"])),
        "sharpe_ratio": (_q_perf(["sharpe_ratio"], 4), _sql_perf(["sharpe_ratio"], 4)),
        "sortino_ratio": (_q_perf(["sortino_ratio"], 4), _sql_perf(["sortino_ratio"], 4)),
        "max_drawdown": (_q_perf(["max_drawdown"]), _sql_perf(["max_drawdown"])),
        "performance_summary": (_q_perf(["average_return", "max_drawdown_abs", "volatility"]),
                                _sql_perf(["average_return", "max_drawdown_abs", "volatility"])),
        "backtest_report": (q_backtest_report, sql_backtest_report()),
        "risk_status": (q_risk_status, SQL_RISK_STATUS),
        "risk_truncate": (q_risk_truncate, sql_risk_truncate()),
        "risk_parameters": (q_risk_parameters, SQL_RISK_PARAMS),
        "risk_optimize": (q_risk_optimize, SQL_RISK_OPT),
        "option_contract_pnl": (q_contract_pnl, SQL_CONTRACT_PNL),
        "option_trade_pnl": (q_trade_pnl, SQL_TRADE_PNL),
        "trade_summary": (q_trade_summary, SQL_TRADE_SUMMARY),
    }
