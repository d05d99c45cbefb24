"""User-defined indicators.

Two kinds of callables are accepted:

* ``kind="column"``: ``fn(sym, **kwargs) -> Column`` built from the window
  kernels; it stays JVM-side inside the suite's single plan.
* ``kind="pandas"``: ``fn(pdf, **kwargs) -> pd.Series`` over one time-ordered
  block of one symbol *including its halo rows*; run by
  ``groupBy(symbol, _blk).applyInPandas`` so each call sees a bounded frame
  (``lookback`` rows of history are guaranteed), never a whole symbol.

Configuration is JSON (never evaluated code); a candidate can be dry-run on a
5-row sample before it is registered.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import kernels as K
from ..plans.layout import BLK, RN


@dataclass
class CustomIndicator:
    name: str
    fn: Callable
    lookback: int = 0
    kind: str = "column"
    kwargs: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, sym: str) -> DataFrame:
        if self.kind == "column":
            return df.withColumn(self.name, self.fn(sym, **self.kwargs))
        if self.kind != "pandas":
            raise ValueError(f"unknown custom indicator kind {self.kind!r}")
        name, fn, kwargs = self.name, self.fn, dict(self.kwargs)
        schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType())])

        def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(RN, kind="stable").reset_index(drop=True)
            vals = fn(pdf, **kwargs)
            return pdf.assign(**{name: pd.Series(vals, dtype="float64").to_numpy()})

        return df.groupBy(sym, BLK).applyInPandas(per_block, schema)


def parse_config(config: str | dict | None) -> dict:
    """Indicator keyword overrides from JSON text (or a dict)."""
    if config is None:
        return {}
    if isinstance(config, dict):
        return dict(config)
    value = json.loads(config)
    if not isinstance(value, dict):
        raise ValueError("indicator config must be a JSON object")
    return value


def dry_run(fn: Callable, kind: str = "column", **kwargs) -> bool:
    """Validate a pandas candidate on a 5-row sample (close, high, low,
    volume = 1..5), as the reference does before registering."""
    if kind != "pandas":
        return callable(fn)
    sample = pd.DataFrame({c: [1.0, 2.0, 3.0, 4.0, 5.0] for c in ("close", "high", "low", "volume")})
    try:
        out = fn(sample, **kwargs)
        return len(out) == len(sample)
    except Exception:  # noqa: BLE001 - a failing candidate is simply rejected
        return False


def register_many(specs) -> list[CustomIndicator]:
    """``[(name, fn, lookback, kind, kwargs_or_json), ...]`` -> indicators."""
    out = []
    for name, fn, lookback, kind, cfg in specs:
        out.append(CustomIndicator(name, fn, lookback, kind, parse_config(cfg)))
    return out


# Examples shipped with the engine (the reference's two sample callables).
def sample_custom_column(sym, window_size=10, column="close"):
    return K.rolling_mean(column, window_size, sym, full=True)


def another_custom_pandas(pdf: pd.DataFrame, window_size=5, column="close") -> pd.Series:
    return pdf[column].rolling(window=window_size).std()


def example_customs(window_a=5, window_b=10) -> list[CustomIndicator]:
    """The GUI wiring: sample (SMA) with window 5, another (std) with 10."""
    return register_many([
        ("Sample_Custom_Indicator", sample_custom_column, window_a, "column",
         json.dumps({"window_size": window_a})),
        ("Another_Custom_Indicator", another_custom_pandas, window_b, "pandas",
         {"window_size": window_b}),
    ])

