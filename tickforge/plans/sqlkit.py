"""Helpers to write the DuckDB oracle SQL for the registered queries.

The oracle is an independent formulation of each operator in plain SQL
(window functions, aggregates, recursive CTEs); these helpers only spell
recurring fragments the same way everywhere.
"""

from __future__ import annotations

from ..sources.tables import EVENT_BARS_SQL, LINE_BARS_SQL

BARS_SQL = {"line": LINE_BARS_SQL, "event": EVENT_BARS_SQL}

P = "PARTITION BY symbol ORDER BY ts"


# Rounding used by every registered query and its oracle: floor(x*10^d + h)/10^d
# with h a hair above one half. IEEE arithmetic makes it bit-identical in both
# engines; moving the tie point off the exact half keeps values that are
# "round" decimals (x.xxxxxx5, common for means of cents) from landing on it,
# where one-ulp summation-order differences would flip the last digit.
HALF = "0.5000001"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits} + {HALF}) / 1e{digits})"


def tdiv(a: str, b: str) -> str:
    """Spark's try_divide: null when the divisor is 0 or null."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def rows(n: int, part: str = P) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def cum(part: str = P) -> str:
    return f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, part: str = P) -> str:
    """pandas rolling(n): null until n non-null values are in the frame."""
    return f"(CASE WHEN count({x}) {rows(n, part)} = {n} THEN {agg}({x}) {rows(n, part)} END)"


def numbered(bars: str = "line") -> str:
    """CTE prefix: bars plus rn (1-based row number per symbol)."""
    return (f"WITH bars AS ({BARS_SQL[bars]}),\n"
            f"s AS MATERIALIZED (SELECT *, row_number() OVER ({P}) AS rn FROM bars)")
