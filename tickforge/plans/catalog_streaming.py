"""Registered streaming queries (§2.12): each drains a file stream derived
from the driver tables into parquet and returns the read-back result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models as M
from ..session import scratch_path
from ..sources.tables import EVENT_BARS_SQL, event_bars, read_table
from ..streaming import jobs as J
from .catalog_indicators import spark_round
from .sqlkit import P, rnd, tdiv

PX = ["open", "high", "low", "close"]


def q_stream_bars(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    src = J.events_stream_dir(spark, ev)
    schema = T.StructType(ev.schema.fields + [T.StructField("part", T.IntegerType())])
    ticks = (spark.readStream.schema(schema).parquet(src)
             .withColumn("ts", F.col("ts").cast("timestamp")))
    bars = J.stream_bars(ticks, "event_type", "ts", "value", ["ts", "event_id"], "1 hour",
                         "5 minutes")
    out = spark.read.parquet(J.run_to_table(spark, bars, "stream-bars"))
    out = out.where(F.col("ts") < F.lit("2100-01-01").cast("timestamp_ntz"))
    return out.select("symbol", "ts", *[spark_round(c).alias(c) for c in PX], "volume")


SQL_STREAM_BARS = (f"SELECT symbol, ts, {', '.join(f'{rnd(c)} AS {c}' for c in PX)}, volume "
                   f"FROM ({EVENT_BARS_SQL}) b")


def q_stream_score(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").withColumn(
        "k", F.regexp_extract("props", r"(\d+)", 1).cast("double"))
    model = M.fit_ridge(ev, ["k"], "value", alpha=1.0)
    src = scratch_path(spark, "score-in")
    ev.select(F.to_json(F.struct("event_id", "k", "value")).alias("value")).write.text(src)
    schema = T.StructType([T.StructField("event_id", T.LongType()),
                           T.StructField("k", T.DoubleType()), T.StructField("value", T.DoubleType())])
    stream = spark.readStream.schema("value STRING").text(src)
    scored = J.stream_score(stream, model, schema)
    out = spark.read.parquet(J.run_to_table(spark, scored, "stream-score"))
    return out.select("event_id", spark_round("prediction", 4).alias("prediction"))


# one-feature ridge (intercept free, alpha on the sum of squares) in closed form
SQL_STREAM_SCORE = f"""
WITH e AS (SELECT event_id, value, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events),
m AS (SELECT regr_sxy(value, k) / (regr_sxx(value, k) + 1.0) AS w, avg(value) AS my, avg(k) AS mk
      FROM e)
SELECT event_id, {rnd('my - w * mk + w * k', 4)} AS prediction FROM e, m"""


def q_stream_risk(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    src = scratch_path(spark, "risk-in")
    bars.write.parquet(os.path.join(src, "part=0"))
    J.closing_record(bars).write.parquet(os.path.join(src, "part=1"))
    stream = spark.readStream.schema(bars.schema).option("recursiveFileLookup", True).parquet(src)
    mon = J.risk_monitor(stream)
    out = spark.read.parquet(J.run_to_table(spark, mon, "stream-risk"))
    return out.select("symbol", "ts", "status", spark_round("high_water").alias("high_water"),
                      spark_round("low_water").alias("low_water"))


SQL_STREAM_RISK = f"""
WITH b AS (SELECT symbol, ts, close,
      max(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hw,
      min(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lw,
      first_value(close) OVER ({P}) AS initial FROM ({EVENT_BARS_SQL}) q),
s AS (SELECT *, {tdiv('hw - close', 'hw')} AS dd, {tdiv('close - initial', 'initial')} AS profit FROM b)
SELECT symbol, ts, CASE WHEN dd > 0.2 THEN 'STOP_TRADING' WHEN dd >= 0.05 THEN 'STOP_LOSS'
       WHEN profit >= 0.1 THEN 'TAKE_PROFIT' ELSE 'CONTINUE_TRADING' END AS status,
       {rnd('hw')} AS high_water, {rnd('lw')} AS low_water FROM s"""


def catalog():
    return {
        "stream_bars": (q_stream_bars, SQL_STREAM_BARS),
        "stream_score": (q_stream_score, SQL_STREAM_SCORE),
        "stream_risk_monitor": (q_stream_risk, SQL_STREAM_RISK),
    }

