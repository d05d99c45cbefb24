"""The feature pipeline as a Spark ML estimator: fitted once, saved, applied to new bars.

Steps: days since the series' first date, lags, full-window rolling mean and
deviation, incomplete rows dropped, target set apart, the other columns
coerced to numbers, mean imputation, scaling, chronological split.

What is fitted are two tables: per series its first date and the time of its
last train row; per scaling group (the whole table unless ``by`` says
otherwise) mean, centre and scale of every feature. Both are Parquet beside
the model's parameters. Nothing per row, per symbol or per label passes
through the driver.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..plans.layout import key_count, maybe_broadcast, stored, with_scalars
from ..schema import SYM, TS, require_columns, require_window
from .features import apply_scaler, fit_scaler
from .quality import label_codes
from .series import run_series

SCALERS = ("standard", "minmax", "robust", "maxabs")


class _FeatureParams(Params):
    target = Param(Params._dummy(), "target", "column to predict; never scaled", TypeConverters.toString)
    sym = Param(Params._dummy(), "sym", "series key", TypeConverters.toString)
    ts = Param(Params._dummy(), "ts", "time column", TypeConverters.toString)
    lags = Param(Params._dummy(), "lags", "lags of the target", TypeConverters.toListInt)
    windows = Param(Params._dummy(), "windows", "rolling windows of the target", TypeConverters.toListInt)
    scaler = Param(Params._dummy(), "scaler", "standard, minmax, robust or maxabs", TypeConverters.toString)
    trainRatio = Param(Params._dummy(), "trainRatio", "share of each series' rows that trains", TypeConverters.toFloat)
    fitOn = Param(Params._dummy(), "fitOn", "train, or all (leaks the test rows)", TypeConverters.toString)
    by = Param(Params._dummy(), "by", "keys of the scaling groups; empty: the whole table", TypeConverters.toListString)
    encode = Param(Params._dummy(), "encode", "text columns that become dense codes", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(target="close", sym=SYM, ts=TS, lags=[1, 2, 3, 5, 10], windows=[5, 10, 20],
                         scaler="standard", trainRatio=0.8, fitOn="train", by=[], encode=[])

    def get(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def check(self, bars: DataFrame) -> None:
        require_columns(bars, [self.get("sym"), self.get("ts"), self.get("target"), *self.get("by"),
                               *self.get("encode")], "feature pipeline")
        for n in [*self.get("lags"), *self.get("windows")]:
            require_window(n)
        clash = {"split", "days_since", "_pos"} & set(bars.columns)
        if clash:
            raise ValueError(f"reserved column name(s) {sorted(clash)}")
        if self.get("scaler") not in SCALERS:
            raise ValueError(f"unknown scaler {self.get('scaler')!r}")
        if self.get("fitOn") not in ("train", "all"):
            raise ValueError("fitOn must be train or all")
        if not 0 < self.get("trainRatio") <= 1:
            raise ValueError("trainRatio must lie in (0, 1]")

    def inputs(self, bars: DataFrame) -> list[str]:
        """Input columns that become features as they are (coerced or encoded)."""
        used = {self.get("sym"), self.get("ts"), self.get("target"), *self.get("by")}
        return [c for c in bars.columns if c not in used]

    def derive(self, bars: DataFrame, **layout) -> DataFrame:
        """Lags and rolling columns; rows without a full history are gone; ``_pos`` counts those that stay."""
        target, sym = self.get("target"), self.get("sym")
        lags = {f"{target}_lag_{n}": n for n in self.get("lags")}
        means = {f"{target}_rolling_mean_{n}": n for n in self.get("windows")}
        stds = {f"{target}_rolling_std_{n}": n for n in self.get("windows")}
        made = [*lags, *means, *stds]

        def build(df, carries):
            df = df.withColumns({**{c: K.lag(target, n, sym) for c, n in lags.items()},
                                 **{c: K.rolling_mean(target, n, sym, full=True) for c, n in means.items()},
                                 **{c: K.rolling_std(target, n, sym, full=True) for c, n in stds.items()}})
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [target, *made]])
            df = df.withColumn("_whole", whole.cast("long"))
            df = df.withColumn("_upto", K.local_cumsum("_whole", sym))
            carries["pos"] = ("_upto", "sum")
            return df

        halo = max([0, *self.get("lags"), *self.get("windows")])
        out = run_series(bars.withColumn(target, F.col(target).cast("double")), build, halo=halo, sym=sym,
                         ts=self.get("ts"), **layout)
        return out.na.drop(subset=[target, *made]).withColumnRenamed("pos", "_pos")

    def numbers(self, df: DataFrame, inputs: list[str], codes: dict[str, DataFrame]) -> DataFrame:
        """Every feature a double: codes joined, text coerced (null where it is no number)."""
        for c in self.get("encode"):
            table = codes[c]
            df = df.join(maybe_broadcast(table, table.count()), c, "left").drop(c).withColumnRenamed("_code", c)
        cast = {}
        for c in inputs:
            kind = dict(df.dtypes)[c]
            x = F.unix_micros(F.col(c).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c)
            x = x.cast("string").try_cast("double") if kind == "string" else x.cast("double")
            cast[c] = F.when(~F.isnan(x), x)
        return df.withColumns(cast)


class FeaturePipeline(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """``FeaturePipeline(lags=[1, 2], ...).fit(bars)`` -> :class:`FeaturePipelineModel`.

    Empty tables fit (every statistic is null). Nulls: a row without symbol, time,
    target or full history is dropped; any other null takes the fitted mean; a feature
    without one number among the fitted rows is left out. Rows at the time of the last
    train row are all train rows.
    """

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _fit(self, bars: DataFrame) -> "FeaturePipelineModel":
        return self.fit_rows(bars)[0]

    def fit_rows(self, bars: DataFrame, **layout) -> tuple["FeaturePipelineModel", DataFrame]:
        """The model and the derived rows it was fitted on (laid out once, written once)."""
        self.check(bars)
        sym, ts, by, inputs = self.get("sym"), self.get("ts"), self.get("by"), self.inputs(bars)
        codes = {c: stored(label_codes(bars, c, "_code"), "labels") for c in self.get("encode")}
        rows = stored(self.numbers(self.derive(bars, **layout), inputs, codes), "feature-rows")
        counts = rows.groupBy(sym).agg(F.count(F.lit(1)).alias("_n"))
        n_sym = key_count(bars, sym)
        first = bars.where(F.col(sym).isNotNull()).groupBy(sym).agg(F.min(ts).alias("_since"))
        in_train = F.col("_pos") <= F.floor(F.col("_n") * self.get("trainRatio"))
        cuts = (rows.select(sym, ts, "_pos").join(maybe_broadcast(counts, n_sym), sym)
                .groupBy(sym).agg(F.max(F.when(in_train, F.col(ts))).alias("_cut")))
        splits = stored(first.join(cuts, sym, "left"), "feature-splits")
        model = FeaturePipelineModel()
        self._copyValues(model)
        model.splits, model.codes, model.inputs_ = splits, codes, inputs
        known = model.dated(rows, n_sym)
        fitted_on = known.where(F.col("split") == "train") if self.get("fitOn") == "train" else known
        feats = model.candidates()
        means = fitted_on.groupBy(*by).agg(*[F.avg(c).alias(f"{c}__m") for c in feats])
        means = stored(means, "feature-means")
        # a column without one number is no feature: one row of flags
        seen = means.agg(*[F.max(F.col(f"{c}__m").isNotNull()).alias(c) for c in feats]).first()
        model.kept = [c for c in feats if seen[c]] or feats  # an empty table keeps all
        scales = fit_scaler(model.imputed(fitted_on, means), model.kept, self.get("scaler"), by or None)
        model.means, model.scales = means, stored(scales, "feature-scales")
        return model, rows


class FeaturePipelineModel(Model, _FeatureParams, MLReadable, MLWritable):
    """Fitted pipeline: ``transform`` gives key, time, ``split``, target and the scaled features.

    A series not seen when fitting has no first date (the mean is imputed) and its
    rows, like all rows after the last train time, are test rows. Features of a scaling
    group not seen when fitting are null.
    """

    splits: DataFrame
    means: DataFrame
    scales: DataFrame
    codes: dict
    kept: list
    inputs_: list

    def candidates(self) -> list[str]:
        target = self.get("target")
        return (["days_since", *self.inputs_] + [f"{target}_lag_{n}" for n in self.get("lags")]
                + [f"{target}_rolling_{k}_{n}" for k in ("mean", "std") for n in self.get("windows")])

    def dated(self, rows: DataFrame, n_sym: int) -> DataFrame:
        sym, ts = self.get("sym"), self.get("ts")
        rows = rows.join(maybe_broadcast(self.splits, n_sym), sym, "left")
        days = F.datediff(F.col(ts), F.col("_since")).cast("double")
        split = F.when(F.col(ts) <= F.col("_cut"), "train").otherwise("test")
        return rows.withColumns({"days_since": days, "split": split}).drop("_since", "_cut", "_pos")

    def _with(self, df: DataFrame, table: DataFrame) -> DataFrame:
        by = self.get("by")
        return df.join(maybe_broadcast(table, table.count()), by, "left") if by else with_scalars(df, table)

    def imputed(self, rows: DataFrame, means: DataFrame) -> DataFrame:
        out = self._with(rows, means).withColumns({c: F.coalesce(c, f"{c}__m") for c in self.kept})
        return out.drop(*[c for c in means.columns if c.endswith("__m")])

    def apply(self, rows: DataFrame) -> DataFrame:
        """Derived rows (see ``fit_rows``) to features."""
        dated = self.dated(rows, self.splits.count())
        out = apply_scaler(self.imputed(dated, self.means), self.scales, self.kept, self.get("scaler"),
                           self.get("by") or None, how="left")
        keys = list(dict.fromkeys([self.get("sym"), self.get("ts"), *self.get("by")]))
        return out.select(*keys, "split", self.get("target"), *self.kept)

    def _transform(self, bars: DataFrame) -> DataFrame:
        self.check(bars)
        require_columns(bars, self.inputs_, "feature pipeline")
        keys = list(dict.fromkeys([self.get("sym"), self.get("ts"), self.get("target"), *self.get("by")]))
        return self.apply(self.numbers(self.derive(bars.select(*keys, *self.inputs_)), self.inputs_, self.codes))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: FeaturePipelineModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        for name, table in [("splits", m.splits), ("means", m.means), ("scales", m.scales),
                            *[(f"codes-{i}", m.codes[c]) for i, c in enumerate(m.get("encode"))]]:
            table.write.parquet(os.path.join(path, name))
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"kept": m.kept, "inputs": m.inputs_})


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeaturePipelineModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        m = self.cls()
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        m.kept, m.inputs_ = meta["kept"], meta["inputs"]
        m.splits, m.means, m.scales = (spark.read.parquet(os.path.join(path, n)) for n in ("splits", "means", "scales"))
        m.codes = {c: spark.read.parquet(os.path.join(path, f"codes-{i}")) for i, c in enumerate(m.get("encode"))}
        return m


def preprocess(bars: DataFrame, column: str = "close", lags=(1, 2), windows=(5,), train_ratio: float = 0.8,
               fit_on: str = "train", scaler: str = "standard", *, by=(), encode=(), sym: str = SYM, ts: str = TS,
               **layout) -> DataFrame:
    """Fit on ``bars`` and transform the same rows; they are laid out once."""
    est = FeaturePipeline(target=column, lags=list(lags), windows=list(windows), trainRatio=train_ratio, fitOn=fit_on,
                          scaler=scaler, by=list(by), encode=list(encode), sym=sym, ts=ts)
    model, rows = est.fit_rows(bars, **layout)
    return model.apply(rows)
