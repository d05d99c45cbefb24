"""Exact quantiles (linear interpolation, like ``quantile_cont``), one way at every size.

1. Equal values of a group become one row with a count (a partial aggregate,
   so a value that half of the rows hold is one row).
2. These rows are range-partitioned by (group, value): Spark samples the keys,
   so a hot group is split over many partitions. The result is written once,
   which fixes the partitions.
3. A running sum inside each partition and a table with one row for each
   (partition, group) give every row the ranks that its value covers.
4. One aggregate picks the two values around each wanted rank.

No group is gathered in one task and nothing passes through the driver. A null
group is a group of its own; null values do not count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def quantiles(df: DataFrame, column: str, probs, by=(), names=None) -> DataFrame:
    """One row per group (or one row) with a column per probability."""
    by = list(by)
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    ensure_checkpoint_dir(df.sparkSession)
    counts = (df.select(*by, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
              .groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")))
    ranged = (counts.repartitionByRange(*by, "_x").withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    inside = Window.partitionBy("_pid", *by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_upto", F.sum("_c").over(inside))
    group = Window.partitionBy(*by)
    chunks = ranged.groupBy("_pid", *by).agg(F.sum("_c").alias("_s"))  # a row per partition and group
    chunks = chunks.select(
        "_pid", *by, F.sum("_s").over(group).alias("_n"),
        (F.sum("_s").over(group.orderBy("_pid")) - F.col("_s")).alias("_before"))
    chunks = chunks.select("_n", "_before", *[F.col(c).alias(f"_k_{c}") for c in ["_pid", *by]])
    same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(chunks[f"_k_{c}"]) for c in ["_pid", *by]])
    ranked = ranged.join(chunks, same)
    end = F.col("_before") + F.col("_upto")

    def at(rank):
        return F.max(F.when((rank < end) & (rank >= end - F.col("_c")), F.col("_x")))

    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"),
                  F.max(h - F.floor(h)).alias(f"_part{i}")]
    out = ranked.groupBy(*by).agg(*picks)
    return out.select(*by, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(n)
        for i, n in enumerate(names)])
