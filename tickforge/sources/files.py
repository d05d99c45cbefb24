"""File scans, sinks and provider-payload ingestion.

Every reader uses an explicit schema (no inference pass over the data);
writers are plain DataFrameWriter calls, partitioned so later scans prune.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BAR_COLUMNS, SYM, TS

CSV_BAR = T.StructType([
    T.StructField("date", T.TimestampNTZType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType()),
    T.StructField("symbol", T.StringType()),
])

# The daily payload field names of the map-form provider.
MAP_FIELDS = ["1. open", "2. high", "3. low", "4. close", "5. volume"]
MAP_SERIES_KEY = "Time Series (Daily)"

ARRAY_ITEM = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("o", T.DoubleType()),
    T.StructField("h", T.DoubleType()), T.StructField("l", T.DoubleType()),
    T.StructField("c", T.DoubleType()), T.StructField("v", T.LongType()),
])
ARRAY_PAYLOAD = T.StructType([T.StructField("results", T.ArrayType(ARRAY_ITEM))])
MAP_PAYLOAD = T.MapType(T.StringType(), T.MapType(T.StringType(),
                                                  T.MapType(T.StringType(), T.StringType())))

#: One row a symbol: the write that holds its rows, and where.
MANIFEST = T.StructType([T.StructField(SYM, T.StringType()), T.StructField("data_version", T.IntegerType()),
                         T.StructField("path", T.StringType())])

REQUEST_LOG = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("status", T.IntegerType()), T.StructField("bytes", T.LongType()),
    T.StructField("symbol", T.StringType()), T.StructField("range", T.StringType()),
])


# ------------------------------------------------------------------ scans
def batch_process_files(spark: SparkSession, paths, schema, cleaner, *, file: str = "file", name: str | None = None,
                        **options) -> DataFrame:
    """``cleaner(rows, file)`` over many CSV files read in one scan.

    ``rows`` has the columns of ``schema`` and, as ``file``, where each row is from: the
    whole path, or group 1 of the pattern ``name`` in it. A cleaner that works on each
    file alone groups by that column (``remove_duplicates`` does, as the column is part of
    the row; ``fill_missing_by`` takes its name).
    """
    if file in T._parse_datatype_string(schema).names if isinstance(schema, str) else file in schema.names:
        raise ValueError(f"the files have a column {file!r}; choose another name")
    df = spark.read.options(header=True, **options).schema(schema).csv(paths)
    origin = F.input_file_name()
    return cleaner(df.withColumn(file, F.regexp_extract(origin, name, 1) if name else origin), file)


def scan_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Read bar CSV files (``{symbol}_data.csv`` files or a ``symbol=``
    partitioned folder) in one scan with a fixed schema."""
    reader = spark.read.option("header", True).schema(CSV_BAR)
    df = reader.csv(path)
    # files named {symbol}_data.csv carry no symbol column: take it from the name
    from_name = F.regexp_extract(F.input_file_name(), r"([^/]+)_data\.csv$", 1)
    df = df.withColumn("symbol", F.coalesce(F.col("symbol"),
                                            F.when(from_name != "", from_name)))
    return df.select(F.col("symbol"), F.col("date").alias(TS), "open", "high", "low", "close",
                     "volume")


def scan_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless request-audit CSV with its key redacted on read."""
    df = spark.read.option("header", False).schema(REQUEST_LOG).csv(path)
    return df.withColumn("url", redact_keys(F.col("url")))


def redact_keys(url):
    return F.regexp_replace(url, r"(?i)(api_?key=)[^&]+", "$1***")


# ------------------------------------------------------------------ sinks
def to_csv_layout(bars: DataFrame) -> DataFrame:
    """Bars in the on-disk column order ``date,open,high,low,close,volume,symbol``."""
    return bars.select(F.col(TS).alias("date"), "open", "high", "low", "close", "volume", SYM)


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists",
             partition_by=None) -> None:
    """CSV with a header; ``ignore`` = skip when present (reference default),
    ``errorifexists`` = fail, ``overwrite`` / ``append``."""
    w = df.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of a location, as Hadoop knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _zone(root: str, processed: bool) -> str:
    return os.path.join(root, f"zone={'processed' if processed else 'raw'}")


def next_version(spark: SparkSession, root: str, processed: bool = False) -> int:
    """Number after the largest that any write of the zone, also a failed one, has used."""
    found = [0]
    for part in ("data", "manifest"):
        files, pattern = _files(spark, os.path.join(_zone(root, processed), part, "version=*"))
        found += [int(s.getPath().getName().partition("=")[2]) for s in files.globStatus(pattern) or []]
    return max(found) + 1


def versions(spark: SparkSession, root: str, processed: bool = False) -> list[int]:
    """Committed versions of a zone, oldest first: those whose manifest Spark has committed."""
    files, pattern = _files(spark, os.path.join(_zone(root, processed), "manifest", "version=*", "_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in files.globStatus(pattern) or [])


def manifest(spark: SparkSession, root: str, processed: bool = False, version: int | None = None) -> DataFrame | None:
    """Rows (symbol, data_version, path) of a committed version, the newest unless given; None before the first.

    Says for every symbol where its rows are: in the version that wrote them last.
    """
    known = versions(spark, root, processed)
    if version is not None and version not in known:
        raise ValueError(f"no committed version {version}; there are {known}")
    if not known:
        return None
    at = version or known[-1]
    return spark.read.schema(MANIFEST).parquet(os.path.join(_zone(root, processed), "manifest", f"version={at}"))


def sink_versioned(spark: SparkSession, df: DataFrame, root: str, processed: bool = False,
                   overwrite: bool = False, versioning: bool = True) -> int:
    """Write bars into a raw or processed zone as a new version; returns its number (or the newest if nothing was new).

    A write lays down the rows of its symbols under ``data/version=N`` and
    then, as its commit, a manifest that names for every symbol of the zone the
    version that holds it. Older data and manifests are never touched: they are
    the archive, and ``read_versioned`` gives any of them back. A write that
    fails leaves no manifest, so readers see the version before it, whole; the
    next write takes a fresh number. With ``versioning`` or ``overwrite`` the rows of
    ``df`` replace those of its symbols; without either, symbols that the
    zone has already are skipped and only new ones are written. Rows without a
    symbol are kept as a symbol of their own. One writer a zone at a time.
    """
    old = manifest(spark, root, processed)
    number = next_version(spark, root, processed)
    if not versioning and not overwrite and old is not None:
        df = df.join(old.select(F.col(SYM).alias("_had")), F.col(SYM).eqNullSafe(F.col("_had")), "left_anti")
    path = os.path.join(_zone(root, processed), "data", f"version={number}")
    df.write.partitionBy(SYM).parquet(path)
    files, where = _files(spark, path)
    if not any(s.isDirectory() for s in files.listStatus(where)):  # no rows
        return (versions(spark, root, processed) or [0])[-1]
    written = spark.read.schema(df.schema).parquet(path)
    new = written.select(SYM).distinct().select(SYM, F.lit(number).alias("data_version"), F.lit(path).alias("path"))
    if old is not None:
        kept = old.join(new.select(F.col(SYM).alias("_new")), F.col(SYM).eqNullSafe(F.col("_new")), "left_anti")
        new = new.unionByName(kept)
    new.coalesce(1).write.parquet(os.path.join(_zone(root, processed), "manifest", f"version={number}"))  # one row a symbol
    return number


def read_versioned(spark: SparkSession, root: str, schema: T.StructType, processed: bool = False,
                   version: int | None = None) -> DataFrame:
    """The rows of a committed version (the newest unless given), with ``version``, the write they come from.

    Each data version is read once, and of it only the symbols that the
    manifest takes from there (partition pruning by a join on the symbol).
    """
    columns = [f.name for f in schema.fields]
    of = manifest(spark, root, processed, version)
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.IntegerType())]))
    if of is None:
        return out
    for v, path in [(r.data_version, r.path) for r in of.select("data_version", "path").distinct().orderBy("data_version").collect()]:
        own = of.where(F.col("data_version") == v).select(F.col(SYM).alias("_own"))
        part = spark.read.schema(schema).parquet(path).join(own, F.col(SYM).eqNullSafe(F.col("_own")), "left_semi")
        out = out.unionByName(part.select(*columns, F.lit(v).alias("version")))
    return out


def sink_sql_table(df: DataFrame, table: str, path: str, if_exists: str = "replace") -> None:
    """Replace/append a catalog table stored at ``path`` (JDBC works the same
    way with ``format("jdbc")`` options for an external database)."""
    mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
    df.write.mode(mode).option("path", path).format("parquet").saveAsTable(table)


def sink_object_store(df: DataFrame, uri: str, mode: str = "overwrite") -> None:
    """``{symbol}/...`` layout on any Hadoop file system URI (s3a://, gs://, file://).

    Rows are dealt by ranges of (symbol, time) first: a symbol is one file, or one for
    each task that its range spans, never one from every task."""
    keys = [c for c in (SYM, TS) if c in df.columns]
    df.repartitionByRange(*keys).write.mode(mode).partitionBy(SYM).parquet(uri)


def sink_predictions(spark: SparkSession, preds: DataFrame, root: str, model: str,
                     run_ts: str, fmt: str = "parquet", compress: bool = True) -> str:
    """Predictions under ``model=/run_ts=`` and one appended row in the run
    summary table. Other formats raise."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    path = os.path.join(root, "predictions")
    w = (preds.withColumn("model", F.lit(model)).withColumn("run_ts", F.lit(run_ts))
         .write.mode("append").partitionBy("model", "run_ts"))
    if compress:
        w = w.option("compression", "gzip")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    summary = (preds.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(model).alias("model"), F.lit(run_ts).alias("run_ts"),
                       F.lit(fmt).alias("format"), "n_rows"))
    summary.write.mode("append").parquet(os.path.join(root, "run_summary"))
    return path


# ------------------------------------------------------------- ingestion
def ingest_map_json(payloads: DataFrame, json_col: str = "payload", symbol_col: str = SYM,
                    key: str = MAP_SERIES_KEY) -> DataFrame:
    """Map-form payload -> bars: explode date -> fields, strip the ``N. ``
    prefix of the field names, cast price double / volume bigint."""
    m = F.from_json(F.col(json_col), MAP_PAYLOAD)
    series = F.element_at(m, key)
    rows = payloads.select(F.col(symbol_col).alias("symbol"),
                           F.explode(series).alias("k", "fields"))
    clean = F.transform_keys("fields", lambda k, v: F.regexp_replace(k, r"^\d+\.\s*", ""))
    rows = rows.select("symbol", "k", clean.alias("f"))
    return rows.select(
        "symbol",
        F.to_timestamp(F.col("k")).cast("timestamp_ntz").alias(TS),
        *[F.element_at("f", c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.element_at("f", "volume").cast("double").cast("bigint").alias("volume"))


def ingest_array_json(payloads: DataFrame, json_col: str = "payload", symbol_col: str = SYM,
                      intraday: bool = True, strict: bool = False) -> DataFrame:
    """Array-form payload -> bars; ``t`` is epoch millis UTC. A payload
    without ``results`` yields no rows, or an error with ``strict``."""
    p = F.from_json(F.col(json_col), ARRAY_PAYLOAD)
    df = payloads.select(F.col(symbol_col).alias("symbol"), p["results"].alias("r"))
    if strict:
        df = df.withColumn("r", F.when(F.col("r").isNotNull(), F.col("r")).otherwise(
            F.raise_error(F.lit("payload has no results"))))
    items = df.select("symbol", F.explode("r").alias("i"))
    ts = F.timestamp_millis(F.col("i.t")).cast("timestamp_ntz")
    if not intraday:
        ts = F.date_trunc("day", ts).cast("timestamp_ntz")
    return items.select("symbol", ts.alias(TS), F.col("i.o").alias("open"),
                        F.col("i.h").alias("high"), F.col("i.l").alias("low"),
                        F.col("i.c").alias("close"), F.col("i.v").alias("volume"))


def ingest_rename_columns(df: DataFrame, direction: str = "lower") -> DataFrame:
    """Provider names (``Date``, ``Open`` / ``1. open``) -> canonical lower
    case (``date`` -> ``ts``), or capitalised in the other direction."""
    import re
    if direction == "capitalize":
        return df.toDF(*[c.capitalize() for c in df.columns])
    names = [re.sub(r"^\d+\.\s*", "", c).strip().lower() for c in df.columns]
    names = [TS if n in ("date", "timestamp", "datetime") else n for n in names]
    return df.toDF(*names)


def source_fallback(primary: DataFrame, secondary: DataFrame, mode: str = "per_bar",
                    sym: str = SYM, ts: str = TS) -> DataFrame:
    """Union two providers. ``per_bar``: keep the primary bar where both have
    one (rank by source); ``all_or_nothing``: use the secondary only when the
    primary returned nothing at all."""
    if mode == "all_or_nothing":
        return secondary if primary.isEmpty() else primary
    if mode != "per_bar":
        raise ValueError(f"unknown fallback mode {mode!r}")
    both = (primary.select(*BAR_COLUMNS).withColumn("_src", F.lit(0))
            .unionByName(secondary.select(*BAR_COLUMNS).withColumn("_src", F.lit(1))))
    # shuffle on (symbol, ts): one bar key per group, so a hot symbol spreads
    best = both.groupBy(sym, ts).agg(F.min_by(F.struct(*[c for c in BAR_COLUMNS
                                                           if c not in (sym, ts)], "_src"),
                                              F.col("_src")).alias("b"))
    return best.select(sym, ts, *[F.col(f"b.{c}").alias(c) for c in BAR_COLUMNS
                                  if c not in (sym, ts)], F.col("b._src").alias("source_rank"))


__all__ = ["scan_csv_bars", "scan_request_log", "sink_csv", "sink_versioned", "read_versioned", "versions", "manifest", "sink_sql_table",
           "sink_object_store", "sink_predictions", "ingest_map_json", "ingest_array_json",
           "ingest_rename_columns", "source_fallback"]
