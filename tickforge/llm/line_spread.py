"""Line dedup by distinct-site spread.

Every line has a HyperLogLog sketch of the sites it is on (Spark's
``approx_count_distinct``: fixed-size registers, merged on the map side).
Lines that the sketch puts clearly over the threshold are boilerplate; lines
near it are counted exactly; the rest stay. Boilerplate is removed from a text
unless it is most of it: such a text is a copy of a document, not a document
with boilerplate, and is left whole for deduplication of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, staged

#: Sites on which a line must be to count as boilerplate.
MIN_SITES = 8
#: Relative standard deviation of the sketches (128 registers).
SKETCH_RSD = 0.1
#: Bytes of a row (text key, site, line), at most.
SEEN_BYTES = 64
#: Estimates from 1 / NEAR to NEAR times the threshold are counted exactly.
NEAR = 2.0


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source",
                 min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """Rows (text_key, lines): for each text with boilerplate the hashes of its boilerplate lines; and a bound on these.

    A text is known by its MD5, a line by a 64-bit hash; lines without a word
    do not count; a null site is a site of its own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.md5(body).alias("text_key"), F.xxhash64(F.col(site), F.col(site).isNull()).alias("site"),
                       F.explode(line_hashes(body)).alias("line"))
    est = rows.groupBy("line").agg(F.approx_count_distinct("site", SKETCH_RSD).alias("est"), F.count(F.lit(1)).alias("n"))
    likely = staged(est.where(F.col("est") * NEAR >= min_sites)
                    .select("line", (F.col("est") >= NEAR * min_sites).alias("sure"), "n"), "likely-lines")
    n_lines, most = likely.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = staged(rows.join(likely, "line").select("text_key", "site", "line", "sure").distinct(), "line-sites",
                  SEEN_BYTES * most)
    exact = (seen.where("not sure").select("line", "site").distinct().groupBy("line")
             .agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line"))
    wide = staged(likely.where("sure").select("line").union(exact), "spread-lines", 8 * n_lines)
    return (seen.select("text_key", "line").distinct().join(wide, "line")
            .groupBy("text_key").agg(F.collect_list("line").alias("lines"))), most


def line_hashes(body):
    """Distinct hashes of the lines that have a word."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def clean(docs: DataFrame, text: str = "text", site: str = "source",
          min_sites: int = MIN_SITES) -> tuple[DataFrame, list[str]]:
    """``docs`` with the cleaned text, its number of lines, those that are boilerplate, and whether it was left whole.

    Returns the frame and the four names (fresh ones). Null text stays null
    and has no lines; rows with equal texts get equal results; an empty table
    gives an empty result.
    """
    key, key2, hits, out, n, wide, whole = fresh(
        docs, "_text_key", "_key", "_hits", "clean_text", "n_lines", "n_spread_lines", "left_whole")
    body = F.coalesce(F.col(text), F.lit(""))
    lines_of, most = spread_lines(docs, text, site, min_sites)
    found = staged(lines_of, "text-lines", SEEN_BYTES * most)
    found = found.withColumnRenamed("text_key", key2).withColumnRenamed("lines", hits)
    found = checked_broadcast(found, F.size(hits) * 8 + 64)
    d = docs.withColumn(key, F.md5(body)).join(found, F.col(key) == F.col(key2), "left")
    (lines, kept) = fresh(d, "_lines", "_kept")
    d = d.withColumn(lines, F.split(F.col(text), "\n"))
    d = d.withColumn(kept, F.when(F.col(hits).isNotNull(), F.filter(
        lines, lambda x: ~F.array_contains(F.col(hits), F.xxhash64(x)))))
    mostly = 2 * F.length(F.array_join(kept, "")) < F.length(F.array_join(lines, ""))
    removed = F.size(lines) - F.size(kept)
    return d.select(
        *docs.columns,
        F.when(F.col(hits).isNull() | mostly, F.col(text)).otherwise(F.array_join(kept, "\n")).alias(out),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n),
        F.when(F.col(hits).isNull(), 0).otherwise(removed).cast("long").alias(wide),
        F.when(F.col(hits).isNull(), False).otherwise(mostly).alias(whole)), [out, n, wide, whole]


def remove(docs: DataFrame, text: str = "text", site: str = "source", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with boilerplate lines removed, and ``size`` (if there is such a column) following the text."""
    d, (out, _, wide, whole) = clean(docs, text, site)
    changed = (F.col(wide) > 0) & ~F.col(whole)
    columns = {c: F.col(c) for c in docs.columns}
    columns[text] = F.col(out)
    if size in docs.columns:
        columns[size] = F.when(changed, F.length(out).cast(docs.schema[size].dataType)).otherwise(F.col(size))
    return d.select(*[v.alias(c) for c, v in columns.items()])
