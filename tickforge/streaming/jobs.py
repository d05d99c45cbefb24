"""Structured Streaming jobs: bars from ticks, model scoring, risk monitor.

Each job is a ``readStream -> transform -> writeStream`` with a checkpoint in
the shared folder, so a restarted driver or lost executor resumes from the
committed offsets. The runners use ``trigger(availableNow=True)`` to drain
what is present (tests, backfills); a service uses a processing-time trigger.
"""

from __future__ import annotations

import os
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import scratch_path


def stream_bars(ticks: DataFrame, sym: str, ts: str, price: str, order: list[str],
                bar: str = "1 hour", watermark: str = "5 minutes") -> DataFrame:
    """Tumbling-window OHLCV bars per symbol; rows later than the watermark
    are dropped. Open/close are the first/last tick by ``order``."""
    key = F.struct(*order)
    return (ticks.withWatermark(ts, watermark)
            .groupBy(F.col(sym).alias("symbol"), F.window(ts, bar).alias("w"))
            .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, key).alias("close"),
                 F.count(F.lit(1)).cast("bigint").alias("volume"))
            .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high",
                    "low", "close", "volume"))


def run_to_table(spark: SparkSession, sdf: DataFrame, name: str, mode: str = "append") -> str:
    """Drain a streaming frame into parquet under the shared folder."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (sdf.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_score(stream: DataFrame, model: PipelineModel, schema: T.StructType,
                 json_col: str = "value") -> DataFrame:
    """JSON records -> parsed columns -> model predictions."""
    parsed = stream.select(F.from_json(F.col(json_col), schema).alias("r")).select("r.*")
    return model.transform(parsed).drop("features")


RISK_STATE = T.StructType([
    T.StructField("started", T.BooleanType()), T.StructField("initial", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("times", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

#: Rows of one output frame of the monitor.
MONITOR_ROWS = 10_000


def risk_marks(values: np.ndarray, initial: float, high: float, low: float, max_drawdown: float,
               stop_loss: float, take_profit: float):
    """(high marks, low marks, statuses) of values in time order; nan is no value."""
    highs = np.fmax.accumulate(np.append(high, values))[1:]
    lows = np.fmin.accumulate(np.append(low, values))[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        drawdown = np.where(highs == 0, np.nan, (highs - values) / highs)
        profit = (values - initial) / initial if initial else np.full(len(values), np.nan)
    status = np.select([drawdown > max_drawdown, drawdown >= stop_loss, profit >= take_profit],
                       ["STOP_TRADING", "STOP_LOSS", "TAKE_PROFIT"], "CONTINUE_TRADING")
    return highs, lows, status


def risk_monitor(bars: DataFrame, sym: str = "symbol", ts: str = "ts", value: str = "close",
                 max_drawdown: float = 0.2, stop_loss: float = 0.05, take_profit: float = 0.1,
                 watermark: str = "1 day") -> DataFrame:
    """High/low-water marks and risk status of a stream of bars: the twin of ``risk_status``.

    Runs on event time. A row waits in its symbol's state until the watermark
    (the newest time seen less ``watermark``) has passed it; then it is marked,
    in the order of time. So the result does not depend on how rows
    are cut into micro-batches or ordered in them, as long as none is later
    than the watermark; later ones are dropped by Spark. A timer at the oldest
    waiting row wakes symbols that get no more rows. The state of a symbol is
    the rows of one watermark delay, 16 bytes each; a micro-batch is read
    batch by batch and only times and values are kept.
    """
    out_schema = T.StructType([T.StructField(sym, T.StringType()),
                               T.StructField(ts, T.TimestampNTZType()),
                               T.StructField("high_water", T.DoubleType()),
                               T.StructField("low_water", T.DoubleType()),
                               T.StructField("status", T.StringType())])

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        started, initial, high, low, times, values = state.get if state.exists else (False, None, None, None, [], [])
        initial, high, low = (np.nan if x is None else x for x in (initial, high, low))
        t = [np.array(times, np.int64)]
        v = [np.array([np.nan if x is None else x for x in values], float)]
        if not state.hasTimedOut:
            for pdf in batches:
                t.append(pdf[ts].to_numpy().astype("datetime64[us]").astype(np.int64))
                v.append(pdf[value].to_numpy(dtype="float64", na_value=np.nan))
        t, v = np.concatenate(t), np.concatenate(v)
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        now = state.getCurrentWatermarkMs()
        due = int(np.searchsorted(t, now * 1000))
        if due and not started:
            started, initial = True, float(v[0])
        for at in range(0, due, MONITOR_ROWS):
            end = min(at + MONITOR_ROWS, due)
            highs, lows, status = risk_marks(v[at:end], initial, high, low, max_drawdown, stop_loss, take_profit)
            high, low = float(highs[-1]), float(lows[-1])
            yield pd.DataFrame({sym: key[0], ts: t[at:end].astype("datetime64[us]"), "high_water": highs,
                                "low_water": lows, "status": status})
        state.update((started, *(None if np.isnan(x) else float(x) for x in (initial, high, low)), t[due:].tolist(),
                      [None if np.isnan(x) else x for x in v[due:].tolist()]))
        if due < len(t):
            state.setTimeoutTimestamp(max(int(t[due] // 1000), now + 1))

    # a watermark needs an instant: the wall-clock time of the bar as if in UTC
    wall = F.col(ts).cast("timestamp_ntz")
    seen = bars.select(F.col(sym), wall.alias(ts), F.col(value).cast("double").alias(value),
                       F.concat(wall.cast("string"), F.lit("Z")).cast("timestamp").alias("_event"))
    seen = seen.withWatermark("_event", watermark).where(F.col(sym).isNotNull() & F.col(ts).isNotNull())
    return seen.groupBy(sym).applyInPandasWithState(
        update, out_schema, RISK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def closing_record(bars: DataFrame, sym: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row of the smallest symbol in the far future: it moves the watermark past all rows of a backfill."""
    least = bars.agg(F.min(sym).alias(sym))
    far = {ts: F.lit("2100-01-01 00:00:00").cast(bars.schema[ts].dataType)}
    return least.select(*[F.col(sym) if c == sym else far.get(c, F.lit(None).cast(bars.schema[c].dataType)).alias(c)
                          for c in bars.columns])


def events_stream_dir(spark: SparkSession, events: DataFrame, with_flush: bool = True) -> str:
    """Copy the events table (plus one far-future record per event type that
    closes the watermark) into a folder a file stream reads from."""
    path = scratch_path(spark, "events-stream")
    events.write.mode("errorifexists").parquet(os.path.join(path, "part=0"))
    if with_flush:
        flush = (events.groupBy("event_type").agg(F.max("event_id").alias("event_id"))
                 .select(F.lit(-1).cast("bigint").alias("event_id"),
                         F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                         F.lit(-1).cast("bigint").alias("user_id"), "event_type",
                         F.lit(0.0).alias("value"), F.lit("{}").alias("props")))
        flush.write.mode("errorifexists").parquet(os.path.join(path, "part=1"))
    return path
