"""Physical-plan checks for the indicator suite."""

import re

from tickforge.operators.indicators import SUITE, with_indicators
from tickforge.sources.tables import line_bars

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suite_plan_shape(spark):
    bars = line_bars(spark, SF001)  # materialized: the plan starts at the bar table
    names = [n for n in SUITE if n != "psar"]
    plan = _plan(with_indicators(bars, names))
    exchanges = re.findall(r"Exchange (\w+)", plan)
    # one shuffle on the series key serves every window of the 24 indicators
    assert [e for e in exchanges if e == "hashpartitioning"] == ["hashpartitioning"]
    assert "SinglePartition" not in plan
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas)", plan)
    assert len(re.findall(r"\bSort \[", plan)) <= 2


def test_only_the_fold_runs_python(spark):
    bars = line_bars(spark, SF001)
    plan = _plan(with_indicators(bars, ["psar", "sma", "ema"]))
    assert len(re.findall(r"FlatMapGroupsInPandas", plan)) == 1
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython)", plan)


def test_date_filter_reaches_the_scan(spark):
    from __spark_entry__ import queries
    df = queries()["filter_date_range"](spark, "/root/testdata/sf0.01")
    plan = _plan(df)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate", plan)
