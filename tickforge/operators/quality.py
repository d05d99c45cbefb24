"""Data validation, cleaning and reshaping (one aggregate pass per check).

Checks return small result frames (never collected data); ``assert_finite``
reads one aggregate row on the driver and raises, which is what a validation
step in a job needs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import with_scalars

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def validate_schema(df: DataFrame, required: dict) -> None:
    """Raise when a required column is absent or has another type (plan time)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for name, dtype in required.items():
        if name not in have:
            raise ValueError(f"missing required column {name!r}")
        want = T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype
        if have[name] != want:
            raise ValueError(f"column {name!r} is {have[name].simpleString()}, "
                             f"expected {want.simpleString()}")


def null_report(df: DataFrame) -> DataFrame:
    """One row: per column whether it holds a null, plus an overall flag."""
    flags = [F.max(F.col(c).isNull().cast("int")).cast("boolean").alias(c) for c in df.columns]
    out = df.agg(*flags)
    return out.withColumn("any_null", functools.reduce(lambda a, b: a | b,
                                                       [F.col(c) for c in df.columns]))


def range_report(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """min / max / violating row count / in_range flag for one column."""
    x = F.col(column)
    return df.agg(F.min(x).alias("min_value"), F.max(x).alias("max_value"),
                  F.count(F.when((x < lo) | (x > hi), 1)).alias("violations")) \
        .withColumn("in_range", F.col("violations") == 0)


def range_violations(df: DataFrame, column: str, lo, hi) -> DataFrame:
    return df.where((F.col(column) < lo) | (F.col(column) > hi))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that occur more than once, with their count."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def remove_duplicates(df: DataFrame, subset=None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def fill_missing_values(df: DataFrame, strategy: str = "mean", value=None,
                        columns=None) -> DataFrame:
    """mean (numeric) + mode (strings; of equally frequent ones the smallest) fill,
    or a constant. The means are one aggregate, each mode a grouped count; both
    are applied as literals."""
    if strategy == "constant":
        if value is None:
            raise ValueError("constant strategy needs a value")
        return df.na.fill(value, subset=columns)
    if strategy != "mean":
        raise ValueError(f"unknown strategy {strategy!r}")
    num = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    strs = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    means = df.agg(*[F.avg(c).alias(c) for c in num]).first() if num else {}
    repl = {c: F.coalesce(F.col(c), F.lit(means[c]).cast(df.schema[c].dataType)) for c in num}
    for c in strs:
        top = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.desc("_n"), c).first())
        if top is not None:
            repl[c] = F.coalesce(F.col(c), F.lit(top[c]))
    return df.withColumns(repl)


def fill_missing_by(df: DataFrame, by: str) -> DataFrame:
    """The mean fill inside each value of ``by``: means of numeric columns and the most frequent
    strings (of equally frequent ones the smallest) come from the rows of the same ``by`` alone.

    The means are one grouped aggregate, each mode a count by (``by``, value), so a hot
    value is pre-aggregated; a column that is null throughout stays so.
    """
    num = [c for c in numeric_columns(df) if c != by]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != by]
    out = df
    if num:
        means = df.groupBy(by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in num])
        out = _with_stats(out, means, by)
    for c in strs:
        counts = df.where(F.col(c).isNotNull()).groupBy(by, c).agg(F.count(F.lit(1)).alias("_n"))
        top = counts.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(c).alias("v")))["v"].alias(f"_mode_{c}"))
        out = _with_stats(out, top, by)
    fill = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}").cast(df.schema[c].dataType)) for c in num}
    fill |= {c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in strs}
    return out.withColumns(fill).select(*df.columns) if fill else df


def _with_stats(df: DataFrame, stats: DataFrame, by: str) -> DataFrame:
    stats = stats.withColumnRenamed(by, "_by")
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Tukey fences from exact quartiles (order statistics at any size)."""
    from ..functions.quantiles import quantiles
    q = quantiles(df, column, [0.25, 0.75], names=["q1", "q3"])
    return q.withColumns({
        "lower": F.col("q1") - factor * (F.col("q3") - F.col("q1")),
        "upper": F.col("q3") + factor * (F.col("q3") - F.col("q1"))})


def remove_outliers_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    b = iqr_bounds(df, column, factor).select("lower", "upper")
    return (with_scalars(df, b).where(F.col(column).between(F.col("lower"), F.col("upper")))
            .select(*df.columns))


#: one_hot makes a column per value; more values than this are an error.
MAX_ONE_HOT = 5000


def one_hot(df: DataFrame, column: str, values=None) -> DataFrame:
    """``{column}_{value}`` 0/1 columns. The distinct values are read once (or
    given); a column with more than ``MAX_ONE_HOT`` of them is refused."""
    if values is None:
        found = df.select(column).distinct().where(F.col(column).isNotNull()).limit(MAX_ONE_HOT + 1).collect()
        if len(found) > MAX_ONE_HOT:
            raise ValueError(f"{column} has more than {MAX_ONE_HOT} values")
        values = sorted(r[0] for r in found)
    return df.withColumns({f"{column}_{v}": (F.col(column) == F.lit(v)).cast("int")
                           for v in values})


def label_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per label with its dense code in sorted order, from 0; null has none.

    Labels are sorted by ranges over many partitions and written; a label's code is
    its place in the partition plus the labels of the partitions before it."""
    from ..plans.layout import rank
    labels = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0))
    ranked, _ = rank(labels, "_all", column)
    return ranked.select(column, (F.col("_rn") - 1).cast("int").alias(out))


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Dense code in sorted order, joined back (see :func:`label_codes`); null stays null.

    The join is a broadcast only while the labels are counted under its limit."""
    from ..plans.layout import maybe_broadcast
    out = out or f"{column}_code"
    codes = label_codes(df, column, out)
    return df.join(maybe_broadcast(codes, df.select(column).distinct().count()), column, "left")


def normalize_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    out = out or f"{column}_norm"
    st = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rng = F.col("_hi") - F.col("_lo")
    return (with_scalars(df, st).withColumn(out, F.when(rng == 0, F.lit(0.0)).otherwise(
        (F.col(column) - F.col("_lo")) / rng)).drop("_lo", "_hi"))


def standardize_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """mean 0, sample std 1 (the reference's test uses pandas ``.std()``)."""
    out = out or f"{column}_std"
    st = df.agg(F.avg(column).alias("_mu"), F.stddev_samp(column).alias("_sd"))
    return (with_scalars(df, st).withColumn(out, F.try_divide(F.col(column) - F.col("_mu"),
                                                          F.col("_sd"))).drop("_mu", "_sd"))


def log_transform_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{column}_log", F.log1p(F.col(column)))


_AGGS = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min,
         "max": F.max, "std": F.stddev_samp, "first": F.first}


def aggregate_data(df: DataFrame, by, spec: dict) -> DataFrame:
    """groupBy(by) with a {column: function-name} map (partial aggregation)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*[_AGGS[fn](F.col(c)).alias(f"{c}_{fn}") for c, fn in spec.items()])


def convert_column_types(df: DataFrame, types: dict) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def drop_sparse_columns(df: DataFrame, thresh: float = 0.8) -> DataFrame:
    """Keep columns with at least ``thresh`` non-null share (one agg pass)."""
    n = F.count(F.lit(1))
    row = df.agg(*[(F.count(F.col(c)) / n).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if row[c] is not None and row[c] >= thresh]
    return df.select(*keep)


def nan_inf_counts(df: DataFrame, columns=None) -> DataFrame:
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    bad = [F.count(F.when(F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")), 1)).alias(c)
           for c in cols]
    return df.agg(*bad)


def assert_finite(df: DataFrame, columns=None) -> None:
    """Raise if any float column holds NaN or an infinity."""
    bad = {c: n for c, n in nan_inf_counts(df, columns).first().asDict().items() if n}
    if bad:
        raise ValueError(f"not finite: {bad}")


def replace_inf_drop(df: DataFrame, columns=None) -> DataFrame:
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    df = df.withColumns({c: F.when(F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")),
                                   F.lit(None)).otherwise(F.col(c)) for c in cols})
    return df.na.drop(subset=cols)


def drop_null_rows(df: DataFrame, subset=None, require_rows: bool = False) -> DataFrame:
    out = df.na.drop(subset=subset)
    if require_rows and out.isEmpty():
        raise ValueError("no rows left after dropping nulls")
    return out
