"""Payload parsing, renames, redaction and sink round trips (FIXTURES A)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickforge.operators.custom import dry_run, parse_config
from tickforge.session import scratch_path
from tickforge.sources import files as IO


def test_map_payload(spark):
    doc = {"Time Series (Daily)": {"2024-07-01": {"1. open": "100.0", "2. high": "101.5",
                                                  "3. low": "99.25", "4. close": "100.75",
                                                  "5. volume": "12345"}}}
    df = spark.createDataFrame([("AAPL", json.dumps(doc))], "symbol string, payload string")
    r = IO.ingest_map_json(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["symbol"], r["ts"], r["open"], r["high"], r["low"], r["close"], r["volume"]) == (
        "AAPL", dt.datetime(2024, 7, 1), 100.0, 101.5, 99.25, 100.75, 12345)


def test_array_payload_daily_and_missing_results(spark):
    doc = {"results": [{"t": 1625074800000, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10}]}
    df = spark.createDataFrame([("AAPL", json.dumps(doc)), ("MSFT", json.dumps({}))],
                               "symbol string, payload string")
    rows = IO.ingest_array_json(df, intraday=False).collect()
    assert len(rows) == 1 and rows[0]["ts"] == dt.datetime(2021, 6, 30)
    with pytest.raises(Exception):
        IO.ingest_array_json(df, strict=True).collect()


def test_rename_both_ways(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10)],
                               "Date timestamp_ntz, Open double, High double, Low double, "
                               "Close double, Volume long")
    low = IO.ingest_rename_columns(df)
    assert low.columns == ["ts", "open", "high", "low", "close", "volume"]
    assert IO.ingest_rename_columns(low, "capitalize").columns[1] == "Open"


def test_redaction(spark):
    df = spark.createDataFrame([("https://x.example/q?symbol=A&apikey=SECRET123&f=1",)], "url string")
    out = df.select(IO.redact_keys(F.col("url")).alias("u")).first()["u"]
    assert "SECRET" not in out and out.endswith("apikey=***&f=1")


def test_csv_sink_modes_and_versions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "column1 int, column2 string")
    path = scratch_path(spark, "t-csv")
    IO.sink_csv(df, path)
    with pytest.raises(Exception):
        IO.sink_csv(df, path, mode="errorifexists")
    IO.sink_csv(df, path, mode="ignore")
    back = spark.read.option("header", True).schema(df.schema).csv(path)
    assert sorted(back.collect()) == sorted(df.collect())
    bars = df.withColumn("symbol", F.lit("A"))
    root = scratch_path(spark, "t-zones")
    assert IO.sink_versioned(spark, bars, root) == 1
    assert IO.sink_versioned(spark, bars, root) == 2
    assert IO.sink_versioned(spark, bars, root, processed=True) == 1


def test_custom_indicator_config_and_dry_run():
    assert parse_config('{"window_size": 5}') == {"window_size": 5}
    with pytest.raises(ValueError):
        parse_config("[1, 2]")
    assert dry_run(lambda pdf: pdf["close"].rolling(2).mean(), "pandas")
    assert not dry_run(lambda pdf: pdf["missing"], "pandas")


def _held(spark, root, schema, version=None):
    rows = IO.read_versioned(spark, root, schema, version=version).select("symbol", "close", "version").collect()
    return sorted((r.symbol or "", r.close, r.version) for r in rows)


def test_versions_keep_every_symbol(spark, tmp_path):
    """Two symbols, several writes and a failed one: nothing is lost, readers see whole versions, the archive stays."""
    schema = "symbol string, ts timestamp_ntz, close double"
    root = str(tmp_path / "zones")

    def bars(*rows):
        return spark.createDataFrame([(s, None, v) for s, v in rows], schema)
    kind = bars(("A", 1.0)).schema
    assert IO.versions(spark, root) == [] and _held(spark, root, kind) == []
    assert IO.sink_versioned(spark, bars(("A", 1.0), ("A", 2.0)), root, versioning=False) == 1
    assert IO.sink_versioned(spark, bars(("B", 3.0), ("A", 9.0)), root, versioning=False) == 2  # A is there: skipped
    assert _held(spark, root, kind) == [("A", 1.0, 1), ("A", 2.0, 1), ("B", 3.0, 2)]
    # a write that fails before its commit
    bars(("A", 7.0)).write.partitionBy("symbol").parquet(f"{root}/zone=raw/data/version=3")
    bars(("A", 7.0)).limit(0).write.parquet(f"{root}/zone=raw/manifest/version=4")
    (tmp_path / "zones/zone=raw/manifest/version=4/_SUCCESS").unlink()
    assert IO.versions(spark, root) == [1, 2] and len(_held(spark, root, kind)) == 3
    assert IO.sink_versioned(spark, bars(("A", 5.0), (None, 6.0)), root, overwrite=True, versioning=False) == 5
    assert _held(spark, root, kind) == [("", 6.0, 5), ("A", 5.0, 5), ("B", 3.0, 2)]
    assert _held(spark, root, kind, version=2) == [("A", 1.0, 1), ("A", 2.0, 1), ("B", 3.0, 2)]
    assert IO.sink_versioned(spark, bars(("A", 1.0), (None, 1.0)), root, versioning=False) == 5  # nothing new
    assert IO.sink_versioned(spark, bars(("A", 1.0)).limit(0), root) == 5
    assert _held(spark, root, kind) == [("", 6.0, 5), ("A", 5.0, 5), ("B", 3.0, 2)]
    with pytest.raises(ValueError, match="no committed version"):
        IO.read_versioned(spark, root, kind, version=3)


def test_batch_process_files_cleans_each_file_alone(spark, tmp_path):
    from tickforge.operators import quality as Q
    (tmp_path / "one.csv").write_text("A,C\n1,x\n,y\n3,y\n")
    (tmp_path / "two.csv").write_text("A,C\n10,\n,b\n20,a\n")
    (tmp_path / "three.csv").write_text("A,C\n,z\n,z\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("one", "two", "three")]
    got = IO.batch_process_files(spark, paths, "A double, C string", Q.fill_missing_by, name=r"([^/]+)\.csv$")
    rows = sorted(((r.file, r.A, r.C) for r in got.collect()), key=str)
    assert rows == sorted([("one", 1.0, "x"), ("one", 2.0, "y"), ("one", 3.0, "y"), ("two", 10.0, "a"), ("two", 15.0, "b"),
                           ("two", 20.0, "a"), ("three", None, "z"), ("three", None, "z")], key=str)
    once = IO.batch_process_files(spark, paths, "A double, C string", lambda d, file: Q.remove_duplicates(d))
    assert once.count() == 7  # the repeated row of the third file
    with pytest.raises(ValueError):
        IO.batch_process_files(spark, paths, "A double, file string", Q.fill_missing_by)
