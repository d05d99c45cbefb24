"""Deep feature synthesis: a graph of stacked primitives, evaluated level by level.

A feature is a column, a transform of a row-level feature or an aggregate of one
per symbol; its depth is the number of primitives stacked. :func:`plan` lists all
features up to a depth; :func:`deep_features` then computes all transforms of one
depth in one laid-out pass (``CUM_MEAN`` shares the running sum of ``CUM_SUM``) and
all aggregates, whatever their depth, in one grouped aggregate joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.layout import RN, key_count, maybe_broadcast, stored
from ..schema import SYM, TS, require_columns
from .series import run_series

DATE_PARTS = {"DAY": F.dayofmonth, "MONTH": F.month, "YEAR": F.year, "WEEKDAY": F.weekday}
RUNNING = ("CUM_SUM", "CUM_MEAN")
AGGREGATES = {"MEAN": F.avg, "SUM": F.sum, "COUNT": F.count, "MAX": F.max, "MIN": F.min}


@dataclass(frozen=True)
class Feature:
    name: str
    primitive: str  # "" for a column
    of: str  # name of the input feature
    depth: int


def plan(columns, ts: str = TS, max_depth: int = 2, transforms=(*DATE_PARTS, *RUNNING),
         aggregates=tuple(AGGREGATES)) -> list[Feature]:
    """All features up to ``max_depth``, inputs before what is stacked on them.

    Date parts apply to the time column, running sums and means to numbers (date
    parts are labels, not numbers), aggregates to any number; nothing stacks on an aggregate.
    """
    if isinstance(max_depth, bool) or not isinstance(max_depth, int) or max_depth < 1:
        raise ValueError(f"max_depth must be a positive integer, got {max_depth!r}")
    unknown = (set(transforms) - set(DATE_PARTS) - set(RUNNING)) | (set(aggregates) - set(AGGREGATES))
    if unknown:
        raise ValueError(f"unknown primitive(s) {sorted(unknown)}")
    out = [Feature(f"{p}({ts})", p, ts, 1) for p in transforms if p in DATE_PARTS]
    level = [Feature(c, "", c, 0) for c in columns]
    for depth in range(1, max_depth + 1):
        out += [Feature(f"{p}({f.name})", p, f.name, depth) for f in level for p in aggregates]
        level = [Feature(f"{p}({f.name})", p, f.name, depth) for f in level for p in transforms if p in RUNNING]
        out += level
    return out


def deep_features(bars: DataFrame, columns=("close", "volume"), max_depth: int = 2,
                  transforms=(*DATE_PARTS, *RUNNING), aggregates=tuple(AGGREGATES), *, sym: str = SYM, ts: str = TS,
                  **layout) -> DataFrame:
    """``bars`` with every feature of :func:`plan`. Null values add nothing to a running sum, which is
    null until the first value; running means divide by the number of rows so far; COUNT counts values."""
    require_columns(bars, [sym, ts, *columns], "deep_features")
    features = plan(columns, ts, max_depth, transforms, aggregates)
    rows = bars.where(F.col(sym).isNotNull() & F.col(ts).isNotNull())
    for depth in range(1, max_depth + 1):
        level = [f for f in features if f.depth == depth and f.primitive in RUNNING]
        if level:
            rows = _running(rows, level, sym, ts, layout)
    rows = rows.withColumns({f.name: DATE_PARTS[f.primitive](F.col(f.of)) for f in features
                             if f.primitive in DATE_PARTS})
    groups = [f for f in features if f.primitive in AGGREGATES]
    if not groups:
        return rows
    rows = stored(rows, "synthesis")
    per_symbol = rows.groupBy(sym).agg(*[AGGREGATES[f.primitive](_q(f.of)).alias(f.name) for f in groups])
    order = [*bars.columns, *[f.name for f in features]]
    return rows.join(maybe_broadcast(per_symbol, key_count(bars, sym)), sym).select(*[_q(c) for c in order])


def _q(name: str):
    return F.col(f"`{name}`")


def _running(rows: DataFrame, level: list[Feature], sym: str, ts: str, layout: dict) -> DataFrame:
    """One pass for the running features of one depth; the running sum of an input is computed once."""
    inputs = list(dict.fromkeys(f.of for f in level))

    def build(df, carries):
        df = df.withColumns({f"_sum{i}": K.local_cumsum(_q(c).cast("double"), sym) for i, c in enumerate(inputs)})
        df = df.withColumn("_row", F.col(RN))
        for i in range(len(inputs)):
            carries[f"_run{i}"] = (f"_sum{i}", "sum")
        at = {c: F.col(f"_run{i}") for i, c in enumerate(inputs)}
        carries["__post__"] = [(f.name, at[f.of] if f.primitive == "CUM_SUM" else at[f.of] / F.col("_row"), [])
                               for f in level]
        return df

    return run_series(rows, build, halo=0, sym=sym, ts=ts, **layout)
