"""Projections, filters, predicates and casts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SYM, TS
from .quality import numeric_columns


def filter_date_range(df: DataFrame, start=None, end=None, ts: str = TS) -> DataFrame:
    """Inclusive [start, end]; an end date covers its whole day (intraday bars).
    Expressed on the raw column so the parquet scan gets the pushed filter."""
    start = start or "1900-01-01"
    end = end or (dt.date.today() - dt.timedelta(days=1)).isoformat()
    lo = F.to_timestamp(F.lit(str(start))).cast("timestamp_ntz")
    hi = F.date_add(F.to_date(F.lit(str(end))), 1).cast("timestamp_ntz")
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def valid_date_string(col) -> Column:
    """YYYY-MM-DD check as a column predicate."""
    c = F.col(col) if isinstance(col, str) else col
    return (c.rlike(r"^\d{4}-\d{2}-\d{2}$")
            & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull())


def select_numeric(df: DataFrame, exclude=("date", "ts", "symbol")) -> DataFrame:
    cols = numeric_columns(df, exclude)
    return df.select(*cols).na.fill(0, subset=cols)


def project_features(df: DataFrame, features, target=None) -> DataFrame:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*features, *([target] if target else []))


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})


def days_since_reference(df: DataFrame, sym: str = SYM, ts: str = TS,
                         out: str = "days_since") -> DataFrame:
    """Days since the symbol's first bar (a per-symbol min joined back)."""
    first = df.groupBy(sym).agg(F.min(ts).alias("_t0"))
    return (df.join(first, sym).withColumn(out, F.datediff(F.col(ts), F.col("_t0")))
            .drop("_t0"))


def date_parts(df: DataFrame, ts: str = TS) -> DataFrame:
    """weekday (Mon=0), day, month, year."""
    return df.withColumns({"weekday": F.weekday(ts), "day": F.dayofmonth(ts),
                           "month": F.month(ts), "year": F.year(ts)})


def datetime_to_int(df: DataFrame, ts: str = TS, out: str = "ts_ns") -> DataFrame:
    return df.withColumn(out, F.unix_micros(F.col(ts).cast("timestamp")) * F.lit(1000))


__all__ = ["filter_date_range", "valid_date_string", "select_numeric", "project_features",
           "coerce_numeric", "days_since_reference", "date_parts", "datetime_to_int"]
