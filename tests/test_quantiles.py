"""Quantiles must equal exact percentiles, also with hot values and null groups."""

from pyspark.sql import functions as F

from tickforge.functions.quantiles import quantiles
from tickforge.sources.tables import read_table

from conftest import SF01

PROBS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(df, column, by=()):
    exact = {tuple(r[c] for c in by): r["_q"] for r in
             df.groupBy(*by).agg(F.percentile(F.col(column).cast("double"), PROBS).alias("_q")).collect()}
    got = quantiles(df, column, PROBS, by=by, names=[f"p{i}" for i in range(len(PROBS))]).collect()
    assert len(got) == len(exact)
    for r in got:
        want = exact[tuple(r[c] for c in by)]
        assert [round(r[f"p{i}"], 9) for i in range(len(PROBS))] == [round(x, 9) for x in want]


def test_global_quantiles_match(spark):
    _check(read_table(spark, SF01, "lineitem"), "l_extendedprice")


def test_grouped_quantiles_with_ties_a_hot_value_and_a_null_group(spark):
    li = read_table(spark, SF01, "lineitem").repartition(7)
    li = li.withColumn("l_returnflag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    hot = F.when(F.col("l_linenumber") > 3, F.lit(7.0)).otherwise(F.col("l_quantity"))
    _check(li.withColumn("v", F.when(F.col("l_tax") > 0.01, hot)), "v", ["l_returnflag"])
