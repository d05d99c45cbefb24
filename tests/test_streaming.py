"""Streaming twins: watermark drops late ticks; the monitor equals the batch."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tickforge.session import scratch_path
from tickforge.streaming import jobs as J


def test_stream_bars_drops_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    src = scratch_path(spark, "t-ticks")
    schema = "event_id long, ts timestamp, event_type string, value double"
    batch1 = [(1, t0, "A", 1.0), (2, t0 + dt.timedelta(minutes=30), "A", 3.0),
              (3, t0 + dt.timedelta(hours=3), "A", 5.0)]
    batch2 = [(4, t0 + dt.timedelta(minutes=10), "A", 100.0),  # late: hour 10 is closed
              (5, t0 + dt.timedelta(days=10), "A", 7.0)]       # closes the watermark
    spark.createDataFrame(batch1, schema).coalesce(1).write.parquet(os.path.join(src, "b1"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    bars = J.stream_bars(stream, "event_type", "ts", "value", ["ts", "event_id"], "1 hour",
                         "5 minutes")
    out = scratch_path(spark, "t-out")
    ck = scratch_path(spark, "t-ck")
    q = (bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    spark.createDataFrame(batch2, schema).coalesce(1).write.parquet(os.path.join(src, "b2"))
    q = (bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {r["ts"]: r for r in spark.read.parquet(out).collect()}
    first = rows[dt.datetime(2024, 1, 1, 10, 0)]
    assert (first["open"], first["high"], first["close"], first["volume"]) == (1.0, 3.0, 3.0, 2)


def _drain(spark, bars, cut, watermark):
    """The monitor over the same rows, written as one file for each value of ``cut`` in its order."""
    src = scratch_path(spark, "t-risk")
    parts = sorted(r[0] for r in bars.select(cut).distinct().collect())
    for i, p in enumerate(parts):
        bars.where(cut == p).coalesce(1).write.parquet(os.path.join(src, f"b{i:03d}"))
    J.closing_record(bars).coalesce(1).write.parquet(os.path.join(src, "b999"))
    # the file stream takes the oldest files first
    for i, name in enumerate(sorted(os.listdir(src.removeprefix("file:")))):
        folder = os.path.join(src.removeprefix("file:"), name)
        for f in os.listdir(folder):
            os.utime(os.path.join(folder, f), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    out = J.run_to_table(spark, J.risk_monitor(stream, watermark=watermark), "t-risk")
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_monitor_equals_batch_for_every_cut(spark):
    """One batch, batches by time, shuffled rows: always the rows of the batch operator."""
    from tickforge.operators.backtest import risk_status
    rows = []
    for s, n in (("A", 120), ("B", 7), ("C", 1)):
        for i in range(n):
            value = None if i % 17 == 5 else 100 + 30 * ((i * 7919) % 41) / 41 - i / 3
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * (3 if s == "B" else 1)), value))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").cache()
    want = risk_status(bars).select("symbol", "ts", "high_water", "low_water", "status")
    want = sorted(map(tuple, want.collect()))
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    assert _drain(spark, bars, F.lit(0), "0 seconds") == want
    assert _drain(spark, bars, F.floor(hour / 20), "0 seconds") == want
    assert _drain(spark, bars, F.pmod(F.xxhash64("symbol", "ts"), F.lit(4)), "30 days") == want


def test_marks_with_and_without_values():
    import numpy as np
    highs, lows, status = J.risk_marks(np.array([10.0, np.nan, 12.0, 9.0, 11.0]), 10.0, np.nan, np.nan, 0.2, 0.05, 0.1)
    assert highs.tolist() == [10, 10, 12, 12, 12] and lows.tolist() == [10, 10, 10, 9, 9]
    assert status.tolist() == ["CONTINUE_TRADING", "CONTINUE_TRADING", "TAKE_PROFIT", "STOP_TRADING", "STOP_LOSS"]
