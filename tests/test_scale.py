"""How plans grow: files of a sink, folds that run once, rows of a task, sliding frames."""

from __future__ import annotations

import contextlib
import glob
import io
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.functions import kernels as K
from tickforge.operators import backtest as BT
from tickforge.operators import indicators as I
from tickforge.operators import models as M
from tickforge.operators.series import run_series
from tickforge.plans import layout
from tickforge.sources import files as IO


def _bars(spark, symbols=6, n=40, nulls=False):
    rng = random.Random(5)
    rows = []
    for s in range(symbols):
        for i in range(n):
            p = 100 + rng.random() * 10
            close = None if nulls and rng.random() < 0.1 else p
            rows.append((f"s{s}", i, p, p + 1, p - 1, close, 10 + i))
    df = spark.createDataFrame(rows, "symbol string, d int, open double, high double, low double, close double, volume bigint")
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("d"))).cast("timestamp_ntz")
    return df.withColumn("ts", ts).drop("d")


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_object_store_has_a_file_a_symbol_not_one_from_every_task(spark, tmp_path):
    bars = _bars(spark).repartition(8, "ts")
    IO.sink_object_store(bars, str(tmp_path / "bucket"))
    files = glob.glob(str(tmp_path / "bucket" / "symbol=*" / "*.parquet"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 6 <= len(files) <= 6 + parts - 1
    assert spark.read.parquet(str(tmp_path / "bucket")).count() == 240


def test_gaps_are_asked_of_the_bars_not_of_the_fold(spark, monkeypatch):
    asked, has_gaps = [], I._has_gaps
    monkeypatch.setattr(I, "_has_gaps", lambda bars, *a: asked.append(bars.columns) or has_gaps(bars, *a))
    out = I.with_indicators(_bars(spark), ["ema", "psar"])
    assert "PSAR" in out.columns and asked and all("PSAR" not in c for c in asked)


def test_risk_reads_a_replay_once(spark):
    ledger = BT.action_ledger(BT.momentum_actions(_bars(spark)))
    assert "FlatMapGroupsInPandas" in _plan(ledger)
    status = BT.risk_status(ledger, "equity")
    assert "FlatMapGroupsInPandas" not in _plan(status)
    assert "Window" not in _plan(BT.risk_truncate(status))


def test_a_replay_of_short_series_deals_its_rows_once(spark):
    actions = BT.momentum_actions(_bars(spark))
    plan = _plan(BT.action_ledger(actions))
    assert plan.count("Exchange") == _plan(actions).count("Exchange") == 1


def test_a_report_reads_a_replay_once_and_writes_no_steps_of_short_series(spark):
    ledger = BT.action_ledger(BT.momentum_actions(_bars(spark)))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    watched = ledger.mapInPandas(count, ledger.schema)
    got = {}
    for kw in ({"largest": 40, "total": 240}, {}, {"chunk": 16}):
        seen.value = 0
        summary, steps = BT.backtest_report(watched, **kw)
        got[str(kw)] = (sorted(map(tuple, summary.collect())), sorted(x for r in steps.collect() for x in r.step_rewards))
        assert seen.value == 240
    assert len(set(map(repr, got.values()))) == 1
    assert "Window" not in _plan(BT.backtest_report(ledger, largest=40, total=240)[0])


def test_shuffle_files_go_with_a_write_that_asks_for_it(spark):
    before = spark.conf.get(layout.LET_GO, None)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return sum("shuffle_" in x for x in local.getAllFiles().mkString("\n").split("\n"))
    at = shuffles()
    out = layout.stored(spark.range(1000).repartition(4, "id").groupBy("id").count(), "gone", let_go=True)
    left = shuffles()
    for _ in range(50):
        left = left if left <= at else time.sleep(0.1) or shuffles()
    assert left <= at and out.count() == 1000
    assert spark.conf.get(layout.LET_GO, None) == before


def test_rolling_means_are_the_sliding_ones_without_sliding(spark):
    windows = {f"m{n}": n for n in (1, 2, 3, 5, 8, 13, 21, 34, 55)}
    for nulls, kw in ((False, {}), (True, {}), (True, {"block_rows": 60})):
        bars = _bars(spark, symbols=2, n=150, nulls=nulls)
        got = run_series(bars, lambda df, _: K.rolling_means(df, "close", windows), halo=56, **kw)
        w = Window.partitionBy("symbol").orderBy("ts")
        full = {f"w{n}": F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, F.avg("close").over(w.rowsBetween(1 - n, 0)))
                for n in windows.values()}
        both = got.join(bars.withColumns(full).drop("close", "open", "high", "low", "volume"), ["symbol", "ts"]).collect()
        assert len(both) == 300
        for r in both:
            for n in windows.values():
                assert (r[f"m{n}"] is None) == (r[f"w{n}"] is None)
                assert r[f"m{n}"] is None or abs(r[f"m{n}"] - r[f"w{n}"]) < 1e-9
    assert "RowFrame, -609" not in _plan(M.sma_window_search(_bars(spark), [2, 610]))


def test_fits_read_bounded_partitions(spark):
    df = spark.range(1000).coalesce(1)
    out = layout.stored_in_parts(df, "parts", part_rows=100)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) <= 200


def test_a_large_table_is_dealt_by_its_size(spark):
    bars = _bars(spark, symbols=64, n=10)
    n = 4 * spark.sparkContext.defaultParallelism
    for kw in ({}, {"block_rows": 4}):
        laid = layout.lay_out(bars, task_rows=640 // n, **kw).df
        assert f", {640 // (640 // n)})" in _plan(laid) or f", {-(-640 // (640 // n))})" in _plan(laid)
        assert laid.where(layout.OWN).count() == 640


def test_row_numbers_come_with_one_numbering(spark):
    from tickforge.operators.features import with_row_index
    plan = _plan(with_row_index(_bars(spark)))
    assert plan.count("row_number()") == 1


def test_residual_exemplars_copy_no_row_for_each_strategy(spark):
    from __spark_entry__ import queries
    assert "explode" not in _plan(queries()["residual_exemplars"](spark, "/root/testdata/sf0.001"))
