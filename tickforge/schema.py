"""Data model: one bar table for all symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYM = "symbol"
TS = "ts"

BAR = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

BAR_COLUMNS = [f.name for f in BAR.fields]

# Rounding applied to every double that leaves a registered query, so the
# Spark result and the DuckDB oracle compare equal regardless of summation order.
DIGITS = 6


def require_columns(df: DataFrame, cols, what: str = "operator") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}")


def require_window(n, name: str = "window") -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError(f"{name} must be a positive integer, got {n!r}")
    return n
