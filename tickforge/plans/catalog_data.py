"""Registered queries: sources/sinks (§2.1), filters (§2.2), quality (§2.3),
joins and sets (§2.4). Sinks write into the shared checkpoint folder and the
query reads the written data back."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import quality as Q
from ..session import scratch_path
from ..sources import files as IO
from ..sources.tables import EVENT_BARS_SQL, LINE_BARS_SQL, bars_from_ticks, event_bars, \
    line_bars, read_table
from .catalog_indicators import spark_round
from .sqlkit import P, rnd

PX = ["open", "high", "low", "close"]


def _round_bars(df, extra=()):
    return df.select("symbol", "ts", *[spark_round(c).alias(c) for c in PX], "volume", *extra)


def _bars_sql(kind="event", extra=""):
    src = EVENT_BARS_SQL if kind == "event" else LINE_BARS_SQL
    return (f"SELECT symbol, ts, {', '.join(f'{rnd(c)} AS {c}' for c in PX)}, volume{extra} "
            f"FROM ({src}) b")


# ------------------------------------------------------------------ §2.1
def q_scan_csv_bars(spark, sf_dir):
    path = scratch_path(spark, "csv_bars")
    IO.sink_csv(event_bars(spark, sf_dir).withColumnRenamed("ts", "date"), path,
                partition_by=["symbol"])
    return _round_bars(IO.scan_csv_bars(spark, path))


def q_sink_csv(spark, sf_dir):
    path = scratch_path(spark, "sink_csv")
    bars = IO.to_csv_layout(line_bars(spark, sf_dir))
    IO.sink_csv(bars, path, mode="errorifexists")
    IO.sink_csv(bars, path, mode="ignore")  # present: skipped, as the reference does
    return _round_bars(IO.scan_csv_bars(spark, path))


def q_sink_versioned(spark, sf_dir):
    root = scratch_path(spark, "zones")
    bars = event_bars(spark, sf_dir)
    IO.sink_versioned(spark, bars, root)
    v = IO.sink_versioned(spark, bars, root)
    return _round_bars(IO.read_versioned(spark, root, bars.schema, version=v), ["version"])


def q_sink_sql_table(spark, sf_dir):
    path = scratch_path(spark, "table")
    name = "bars_" + path.rsplit("-", 1)[-1]
    IO.sink_sql_table(event_bars(spark, sf_dir), name, path, "replace")
    IO.sink_sql_table(event_bars(spark, sf_dir), name, path, "replace")
    return _round_bars(spark.table(name))


def q_sink_object_store(spark, sf_dir):
    uri = scratch_path(spark, "bucket")
    IO.sink_object_store(line_bars(spark, sf_dir), uri)
    return _round_bars(spark.read.parquet(uri))


def q_sink_predictions(spark, sf_dir):
    root = scratch_path(spark, "preds")
    preds = line_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("prediction"))
    IO.sink_predictions(spark, preds, root, "baseline", "run1", "parquet", True)
    back = spark.read.parquet(f"{root}/predictions")
    summary = spark.read.parquet(f"{root}/run_summary")
    run = summary.where((F.col("model") == "baseline") & (F.col("run_ts") == "run1"))
    run = run.select("model", "run_ts", "n_rows")
    back = back.withColumn("run_ts", F.col("run_ts").cast("string"))
    return (back.join(run, ["model", "run_ts"])
            .select("symbol", "ts", spark_round("prediction").alias("prediction"), "model",
                    F.col("run_ts").cast("string").alias("run_ts"), "n_rows"))


SQL_SINK_PREDICTIONS = (f"SELECT symbol, ts, {rnd('close')} AS prediction, 'baseline' AS model, "
                        f"'run1' AS run_ts, count(*) OVER () AS n_rows FROM ({LINE_BARS_SQL}) b")


def _payload_days(spark, sf_dir):
    # one provider document per (symbol, day): at most 24 hourly bars each
    b = event_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return b


def q_ingest_map_json(spark, sf_dir):
    b = _payload_days(spark, sf_dir)
    fields = F.create_map(*[x for name, col in zip(IO.MAP_FIELDS, PX + ["volume"])
                            for x in (F.lit(name), F.col(col).cast("string"))])
    docs = (b.groupBy("symbol", "day")
            .agg(F.map_from_entries(F.collect_list(F.struct(
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), fields))).alias("series"))
            .select("symbol", F.to_json(F.create_map(F.lit(IO.MAP_SERIES_KEY),
                                                     F.col("series"))).alias("payload")))
    return _round_bars(IO.ingest_map_json(docs))


def q_ingest_array_json(spark, sf_dir):
    b = _payload_days(spark, sf_dir)
    item = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
                    F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                    F.col("close").alias("c"), F.col("volume").alias("v"))
    docs = (b.groupBy("symbol", "day").agg(F.collect_list(item).alias("results"))
            .select("symbol", F.to_json(F.struct("results")).alias("payload")))
    return _round_bars(IO.ingest_array_json(docs))


def q_ingest_rename(spark, sf_dir):
    provider = line_bars(spark, sf_dir).toDF("Symbol", "Date", "1. Open", "2. High", "3. Low",
                                             "4. Close", "5. Volume")
    return _round_bars(IO.ingest_rename_columns(provider))


def _status_bars(spark, sf_dir, status):
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    return bars_from_ticks(li, "l_suppkey", "l_shipdate",
                           F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
                           volume="l_quantity",
                           order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                  "l_extendedprice"])


def q_source_fallback(spark, sf_dir):
    out = IO.source_fallback(_status_bars(spark, sf_dir, "O"), _status_bars(spark, sf_dir, "F"))
    return _round_bars(out, ["source_rank"])


def _status_bars_sql(status):
    return LINE_BARS_SQL.replace("FROM lineitem", f"FROM lineitem WHERE l_linestatus = '{status}'")


SQL_SOURCE_FALLBACK = f"""
WITH u AS (SELECT *, 0 AS source_rank FROM ({_status_bars_sql('O')}) a
           UNION ALL SELECT *, 1 AS source_rank FROM ({_status_bars_sql('F')}) b),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY source_rank) AS k FROM u)
SELECT symbol, ts, {', '.join(f'{rnd(c)} AS {c}' for c in PX)}, volume, source_rank
FROM r WHERE k = 1"""

_URL = ("'https://data.example.com/query?function=daily&symbol=' || event_type || "
        "'&apikey=K' || CAST(user_id AS VARCHAR)")


def q_scan_request_log(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    log = ev.select(F.expr(_URL.replace("VARCHAR", "STRING")).alias("url"), F.col("ts").alias("fetched_at"),
                    F.when(F.col("value") > 45, 429).otherwise(200).alias("status"),
                    F.floor(F.col("value") * 100).cast("bigint").alias("bytes"),
                    F.col("event_type").alias("symbol"), F.lit("full").alias("range"))
    path = scratch_path(spark, "request_log")
    log.write.mode("errorifexists").option("header", False).csv(path)
    back = IO.scan_request_log(spark, path)
    return (back.groupBy("symbol", "status")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"),
                 F.count_distinct("url").alias("distinct_urls"),
                 F.max(F.col("url").contains("K1").cast("int")).alias("leaked")))


SQL_REQUEST_LOG = f"""
WITH l AS (SELECT regexp_replace({_URL}, '(?i)(api_?key=)[^&]+', '\\1***') AS url,
                  CASE WHEN value > 45 THEN 429 ELSE 200 END AS status,
                  CAST(floor(value * 100) AS BIGINT) AS bytes, event_type AS symbol FROM events)
SELECT symbol, status, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes,
       count(DISTINCT url) AS distinct_urls,
       max(CAST(contains(url, 'K1') AS INTEGER)) AS leaked
FROM l GROUP BY symbol, status"""


# ------------------------------------------------------------------ §2.2
def q_filter_date_range(spark, sf_dir):
    # filter the ticks, not the bars: the range reaches the parquet scan as a
    # pushed filter (and partition pruning on a date-partitioned table); for
    # day bars [start, end + 1 day) on the tick time selects the same bars
    li = FL.filter_date_range(read_table(spark, sf_dir, "lineitem"), "1996-01-01", "1996-12-31",
                              ts="l_shipdate")
    bars = bars_from_ticks(li, "l_suppkey", "l_shipdate",
                           F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
                           volume="l_quantity",
                           order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                  "l_extendedprice"])
    return _round_bars(bars)


def q_validate_dates(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    cands = (o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
             .unionByName(o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd")
                                   .alias("s")))
             .unionByName(o.select("o_orderkey", F.col("o_orderpriority").alias("s"))))
    return cands.withColumn("is_valid", FL.valid_date_string("s"))


SQL_VALIDATE_DATES = """
WITH c AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders
           UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') FROM orders
           UNION ALL SELECT o_orderkey, o_orderpriority FROM orders)
SELECT o_orderkey, s, (regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}')
       AND try_strptime(s, '%Y-%m-%d') IS NOT NULL) AS is_valid FROM c"""


def q_select_numeric(spark, sf_dir):
    return FL.select_numeric(read_table(spark, sf_dir, "customer"))


SQL_SELECT_NUMERIC = ("SELECT coalesce(c_custkey, 0) AS c_custkey, coalesce(c_nationkey, 0) AS "
                      "c_nationkey, coalesce(c_acctbal, 0) AS c_acctbal FROM customer")


def q_project_features(spark, sf_dir):
    return FL.project_features(read_table(spark, sf_dir, "lineitem"),
                               ["l_quantity", "l_extendedprice", "l_discount"], "l_tax")


def q_coerce_numeric(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", r"(\d+)", 1).alias("k"),
        F.col("event_type").alias("kind"))
    return FL.coerce_numeric(ev, ["k", "kind"])


SQL_COERCE = ("SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k, "
              "TRY_CAST(event_type AS DOUBLE) AS kind FROM events")


def q_days_since(spark, sf_dir):
    return FL.days_since_reference(line_bars(spark, sf_dir)).select("symbol", "ts", "days_since")


SQL_DAYS_SINCE = (f"SELECT symbol, ts, CAST(date_diff('day', min(ts) OVER (PARTITION BY symbol), ts)"
                  f" AS INTEGER) AS days_since FROM ({LINE_BARS_SQL}) b")


def q_date_parts(spark, sf_dir):
    return FL.date_parts(event_bars(spark, sf_dir)).select("symbol", "ts", "weekday", "day",
                                                           "month", "year")


SQL_DATE_PARTS = (f"SELECT symbol, ts, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, "
                  f"CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, "
                  f"CAST(year(ts) AS INTEGER) AS year FROM ({EVENT_BARS_SQL}) b")


def q_datetime_to_int(spark, sf_dir):
    return FL.datetime_to_int(read_table(spark, sf_dir, "events")).select("event_id", "ts_ns")


SQL_DT_INT = "SELECT event_id, epoch_us(ts) * 1000 AS ts_ns FROM events"


def _thin_bars(spark, sf_dir):
    return line_bars(spark, sf_dir).withColumn(
        "px", F.when(F.col("volume") >= 30, F.col("close")))


_THIN_SQL = f"(SELECT *, CASE WHEN volume >= 30 THEN close END AS px FROM ({LINE_BARS_SQL}) b)"


def q_drop_null_rows(spark, sf_dir):
    out = Q.drop_null_rows(_thin_bars(spark, sf_dir), require_rows=True)
    return out.select("symbol", "ts", spark_round("px").alias("px"))


SQL_DROP_NULL = f"SELECT symbol, ts, {rnd('px')} AS px FROM {_THIN_SQL} t WHERE px IS NOT NULL"


def q_drop_sparse(spark, sf_dir):
    df = _thin_bars(spark, sf_dir).withColumn(
        "big_px", F.when(F.col("volume") >= 150, F.col("close")))
    kept = set(Q.drop_sparse_columns(df, 0.8).columns)
    n = F.count(F.lit(1))
    rep = df.agg(*[(F.count(F.col(c)) / n).alias(c) for c in df.columns])
    stack = F.expr("stack({}, {})".format(
        len(df.columns), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in df.columns)))
    return (rep.select(stack.alias("column_name", "non_null_share"))
            .withColumn("non_null_share", spark_round("non_null_share"))
            .withColumn("kept", F.col("column_name").isin(sorted(kept))))


def sql_drop_sparse():
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume", "px", "big_px"]
    src = f"(SELECT *, CASE WHEN volume >= 150 THEN close END AS big_px FROM {_THIN_SQL} t) u"
    parts = [f"SELECT '{c}' AS column_name, count({c}) / count(*) AS share FROM {src}" for c in cols]
    return ("SELECT column_name, " + rnd("share") + " AS non_null_share, share >= 0.8 AS kept FROM ("
            + " UNION ALL ".join(parts) + ") x")


def q_check_nan_inf(spark, sf_dir):
    b = line_bars(spark, sf_dir).withColumn(
        "x", F.when(F.col("high") == F.col("low"), F.lit(float("inf")))
        .otherwise(F.col("close") / (F.col("high") - F.col("low"))))
    bad = Q.nan_inf_counts(b, ["x"]).first()["x"]
    out = Q.replace_inf_drop(b, ["x"])
    return out.select("symbol", "ts", spark_round("x").alias("x"), F.lit(bad).cast("bigint")
                      .alias("bad_values"))


SQL_NAN_INF = f"""
WITH b AS (SELECT *, CASE WHEN high = low THEN 'inf'::DOUBLE ELSE close / (high - low) END AS x
           FROM ({LINE_BARS_SQL}) q)
SELECT symbol, ts, {rnd('x')} AS x, (SELECT count(*) FROM b WHERE isinf(x) OR isnan(x)) AS bad_values
FROM b WHERE NOT (isinf(x) OR isnan(x)) AND x IS NOT NULL"""


def q_label_encode(spark, sf_dir):
    return Q.label_encode(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
                          "c_mktsegment")


SQL_LABEL = ("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 "
             "AS INTEGER) AS c_mktsegment_code FROM customer")


# ------------------------------------------------------------------ §2.3
def q_validate_schema(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    Q.validate_schema(bars, {"symbol": "string", "ts": "timestamp_ntz", "open": "double",
                             "high": "double", "low": "double", "close": "double",
                             "volume": "bigint"})
    try:
        Q.validate_schema(bars, {"volume": "double"})
        wrong_type_caught = False
    except ValueError:
        wrong_type_caught = True
    return bars.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "wrong_type_caught", F.lit(wrong_type_caught))


def q_check_nulls(spark, sf_dir):
    return Q.null_report(_thin_bars(spark, sf_dir).select("symbol", "ts", "close", "px"))


SQL_CHECK_NULLS = (f"SELECT bool_or(symbol IS NULL) AS symbol, bool_or(ts IS NULL) AS ts, "
                   f"bool_or(close IS NULL) AS close, bool_or(px IS NULL) AS px, "
                   f"bool_or(symbol IS NULL OR ts IS NULL OR close IS NULL OR px IS NULL) AS any_null "
                   f"FROM {_THIN_SQL} t")


def q_validate_range(spark, sf_dir):
    return Q.range_report(read_table(spark, sf_dir, "lineitem"), "l_discount", 0.0, 0.08)


SQL_VALIDATE_RANGE = ("SELECT min(l_discount) AS min_value, max(l_discount) AS max_value, "
                      "count(*) FILTER (WHERE l_discount < 0.0 OR l_discount > 0.08) AS violations, "
                      "count(*) FILTER (WHERE l_discount < 0.0 OR l_discount > 0.08) = 0 AS in_range "
                      "FROM lineitem")


def q_validate_unique(spark, sf_dir):
    return Q.duplicate_values(read_table(spark, sf_dir, "orders"), "o_custkey")


SQL_VALIDATE_UNIQUE = ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey "
                       "HAVING count(*) > 1")


def q_remove_duplicates(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return Q.remove_duplicates(li)


SQL_REMOVE_DUP = "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem"


def q_fill_missing(spark, sf_dir):
    out = Q.fill_missing_values(_thin_bars(spark, sf_dir).select("symbol", "ts", "px", "volume"))
    return out.select("symbol", "ts", spark_round("px").alias("px"), "volume")


SQL_FILL_MISSING = (f"SELECT symbol, ts, {rnd('coalesce(px, avg(px) OVER ())')} AS px, volume "
                    f"FROM {_THIN_SQL} t")


def q_remove_outliers(spark, sf_dir):
    return Q.remove_outliers_iqr(read_table(spark, sf_dir, "orders")
                                 .select("o_orderkey", "o_totalprice"), "o_totalprice")


SQL_OUTLIERS = """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q
WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


def q_one_hot(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return Q.one_hot(o, "o_orderstatus")


SQL_ONE_HOT = ("SELECT o_orderkey, o_orderstatus, "
               + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS o_orderstatus_{v}"
                           for v in ("F", "O", "P")) + " FROM orders")


def q_normalize(spark, sf_dir):
    out = Q.normalize_column(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"),
                             "p_retailprice")
    return out.select("p_partkey", spark_round("p_retailprice_norm").alias("p_retailprice_norm"))


SQL_NORMALIZE = (f"SELECT p_partkey, {rnd('(p_retailprice - min(p_retailprice) OVER ()) / '
                 '(max(p_retailprice) OVER () - min(p_retailprice) OVER ())')} AS p_retailprice_norm "
                 "FROM part")


def q_standardize(spark, sf_dir):
    out = Q.standardize_column(read_table(spark, sf_dir, "part").select("p_partkey",
                                                                        "p_retailprice"),
                               "p_retailprice")
    return out.select("p_partkey", spark_round("p_retailprice_std").alias("p_retailprice_std"))


SQL_STANDARDIZE = (f"SELECT p_partkey, {rnd('(p_retailprice - avg(p_retailprice) OVER ()) / '
                   'stddev_samp(p_retailprice) OVER ()')} AS p_retailprice_std FROM part")


def q_log_transform(spark, sf_dir):
    out = Q.log_transform_column(read_table(spark, sf_dir, "lineitem")
                                 .select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")
    return out.select("l_orderkey", "l_linenumber", spark_round("l_quantity_log")
                      .alias("l_quantity_log"))


SQL_LOG = (f"SELECT l_orderkey, l_linenumber, {rnd('ln(1 + l_quantity)')} AS l_quantity_log "
           "FROM lineitem")


def q_aggregate(spark, sf_dir):
    out = Q.aggregate_data(read_table(spark, sf_dir, "lineitem"), "l_returnflag",
                           {"l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "max"})
    return out.select("l_returnflag", *[spark_round(c).alias(c) for c in out.columns[1:]])


SQL_AGGREGATE = (f"SELECT l_returnflag, {rnd('sum(l_quantity)')} AS l_quantity_sum, "
                 f"{rnd('avg(l_extendedprice)')} AS l_extendedprice_mean, "
                 f"{rnd('max(l_discount)')} AS l_discount_max FROM lineitem GROUP BY l_returnflag")


def q_convert_types(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return Q.convert_column_types(o, {"o_orderkey": "string", "o_custkey": "double",
                                      "o_orderdate": "date"})


SQL_CONVERT = ("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS "
               "o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")


def q_batch_files(spark, sf_dir):
    path = scratch_path(spark, "batch_files")
    (read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
     .write.mode("errorifexists").option("header", True).partitionBy("l_returnflag").csv(path))
    schema = "l_orderkey BIGINT, l_quantity DOUBLE, l_returnflag STRING"
    cleaned = IO.batch_process_files(spark, path, schema, lambda rows, file: Q.remove_duplicates(rows),
                                     name=r"l_returnflag=([^/]+)")
    return (cleaned.groupBy("file").agg(F.count(F.lit(1)).alias("rows"),
                                 spark_round(F.sum("l_quantity")).alias("quantity")))


SQL_BATCH_FILES = (f"SELECT l_returnflag AS file, count(*) AS rows, {rnd('sum(l_quantity)')} AS "
                   "quantity FROM (SELECT DISTINCT l_orderkey, l_quantity, l_returnflag FROM "
                   "lineitem) d GROUP BY l_returnflag")


def q_bulk_write(spark, sf_dir):
    path = scratch_path(spark, "bulk")
    li = read_table(spark, sf_dir, "lineitem")
    li.write.mode("errorifexists").parquet(path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows"),
                    spark_round(F.sum("l_extendedprice"), 2).alias("total"))


SQL_BULK = f"SELECT count(*) AS rows, {rnd('sum(l_extendedprice)', 2)} AS total FROM lineitem"


# ------------------------------------------------------------------ §2.4
def q_join_inner(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                   F.col("o_custkey").alias("c_custkey"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                   "n_name")
    frames = [li, o, c, n]
    keys = ["l_orderkey", "c_custkey", "c_nationkey"]
    out = functools.reduce(lambda a, kb: a.join(kb[1], kb[0], "inner"), zip(keys, frames[1:]),
                           frames[0])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "c_custkey", "c_nationkey",
                      "n_name")


SQL_JOIN_INNER = """
SELECT l_orderkey, l_linenumber, l_quantity, o_custkey AS c_custkey, c_nationkey, n_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey"""


def q_join_semi(spark, sf_dir):
    keys = (read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
            .select(F.col("l_suppkey").cast("string").alias("symbol"),
                    F.col("l_shipdate").alias("ts")))
    return _round_bars(line_bars(spark, sf_dir).join(keys, ["symbol", "ts"], "left_semi"))


SQL_JOIN_SEMI = (_bars_sql("line") + " WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R'"
                 " AND CAST(l_suppkey AS VARCHAR) = b.symbol AND l_shipdate = b.ts)")


def q_join_positional(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    X = bars.select("symbol", "ts", "open", "high", "low")
    y = bars.select("symbol", "ts", F.col("close").alias("target"))
    out = X.join(y, ["symbol", "ts"], "inner")
    return out.select("symbol", "ts", *[spark_round(c).alias(c) for c in
                                        ("open", "high", "low", "target")])


SQL_JOIN_POSITIONAL = (f"SELECT symbol, ts, {rnd('open')} AS open, {rnd('high')} AS high, "
                       f"{rnd('low')} AS low, {rnd('close')} AS target FROM ({LINE_BARS_SQL}) b")


def q_union_append(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    filled = F.col("o_orderstatus").eqNullSafe("F")
    existing = o.where(filled).select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = o.where(~filled).select("o_orderkey", "o_totalprice")
    return existing.unionByName(new, allowMissingColumns=True)


SQL_UNION = ("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' "
             "UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders "
             "WHERE o_orderstatus IS DISTINCT FROM 'F'")


def q_sort_by_time(spark, sf_dir):
    return _round_bars(event_bars(spark, sf_dir).orderBy("symbol", "ts"))


def q_top_n(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts")
    b = line_bars(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return _round_bars(b.where(F.col("k") <= 5))


SQL_TOP_N = (f"SELECT symbol, ts, {', '.join(f'{rnd(c)} AS {c}' for c in PX)}, volume FROM "
             f"(SELECT *, row_number() OVER ({P}) AS k FROM ({LINE_BARS_SQL}) b) q WHERE k <= 5")


def catalog():
    ev, li = _bars_sql("event"), _bars_sql("line")
    return {
        "scan_csv_bars": (q_scan_csv_bars, ev),
        "sink_csv": (q_sink_csv, li),
        "sink_versioned": (q_sink_versioned, _bars_sql("event", ", 2 AS version")),
        "sink_sql_table": (q_sink_sql_table, ev),
        "sink_object_store": (q_sink_object_store, li),
        "sink_predictions": (q_sink_predictions, SQL_SINK_PREDICTIONS),
        "ingest_map_json": (q_ingest_map_json, ev),
        "ingest_array_json": (q_ingest_array_json, ev),
        "ingest_rename_columns": (q_ingest_rename, li),
        "source_fallback": (q_source_fallback, SQL_SOURCE_FALLBACK),
        "scan_request_log": (q_scan_request_log, SQL_REQUEST_LOG),
        "filter_date_range": (q_filter_date_range, li + " WHERE ts >= TIMESTAMP '1996-01-01' AND "
                                                      "ts < TIMESTAMP '1997-01-01'"),
        "validate_date_strings": (q_validate_dates, SQL_VALIDATE_DATES),
        "select_numeric": (q_select_numeric, SQL_SELECT_NUMERIC),
        "project_features": (q_project_features,
                             "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"),
        "coerce_numeric": (q_coerce_numeric, SQL_COERCE),
        "days_since_reference": (q_days_since, SQL_DAYS_SINCE),
        "date_parts": (q_date_parts, SQL_DATE_PARTS),
        "datetime_to_int": (q_datetime_to_int, SQL_DT_INT),
        "drop_null_rows": (q_drop_null_rows, SQL_DROP_NULL),
        "drop_sparse_columns": (q_drop_sparse, sql_drop_sparse()),
        "check_nan_inf": (q_check_nan_inf, SQL_NAN_INF),
        "label_encode": (q_label_encode, SQL_LABEL),
        "validate_schema": (q_validate_schema, f"SELECT count(*) AS rows, true AS wrong_type_caught "
                                               f"FROM ({LINE_BARS_SQL}) b"),
        "check_for_nulls": (q_check_nulls, SQL_CHECK_NULLS),
        "validate_column_range": (q_validate_range, SQL_VALIDATE_RANGE),
        "validate_unique_values": (q_validate_unique, SQL_VALIDATE_UNIQUE),
        "remove_duplicates": (q_remove_duplicates, SQL_REMOVE_DUP),
        "fill_missing_values": (q_fill_missing, SQL_FILL_MISSING),
        "remove_outliers_iqr": (q_remove_outliers, SQL_OUTLIERS),
        "one_hot": (q_one_hot, SQL_ONE_HOT),
        "normalize_column": (q_normalize, SQL_NORMALIZE),
        "standardize_column": (q_standardize, SQL_STANDARDIZE),
        "log_transform_column": (q_log_transform, SQL_LOG),
        "aggregate_data": (q_aggregate, SQL_AGGREGATE),
        "convert_column_types": (q_convert_types, SQL_CONVERT),
        "batch_process_files": (q_batch_files, SQL_BATCH_FILES),
        "bulk_write": (q_bulk_write, SQL_BULK),
        "join_inner_equi": (q_join_inner, SQL_JOIN_INNER),
        "join_index_align": (q_join_semi, SQL_JOIN_SEMI),
        "join_positional": (q_join_positional, SQL_JOIN_POSITIONAL),
        "union_append": (q_union_append, SQL_UNION),
        "sort_by_time": (q_sort_by_time, ev),
        "top_n_preview": (q_top_n, SQL_TOP_N),
    }

