"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cutting_stock, filter_lattice, hash_tree, host_quality, line_spread, multi_index, ns_bounds, oph_dedup, page_wrapper,
               secret_scan, url_aliases, word_bpe, zip_warc)
from .common import table


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.place(table(spark, sf_dir, "documents"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged, (m, base, host, kept) = host_quality.judge(docs, carry=["doc_id"])
    return judged.select("doc_id", f"{m}.n_words", f"{m}.word_chars", f"{m}.n_symbols", f"{m}.n_dup_lines",
                         f"{m}.n_repeat_words", base, host, kept)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (_, links, component) = multi_index.near_vectors(table(spark, sf_dir, "embeddings"))
    found = found.select("vec_id", F.col(links).alias("n_links"), F.col(component).alias("component"))
    names = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return found.join(names, "component").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_page_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, (text, *counts) = page_wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"), *counts)


def op5_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], ids=False)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d, (text, *counts) = line_spread.clean(docs)
    return d.select("doc_id", *counts, F.col(text).alias("text"))


def op9_oph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by doc_id: the component's smallest doc_id stands for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, (_, n, component) = oph_dedup.near_duplicates(docs, size=2, percent=80)
    found = found.select("doc_id", F.col(n).alias("n_shingles"), F.col(component).alias("component"))
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "component").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(table(spark, sf_dir, "documents"))


def op11_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op12_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, history = ns_bounds.cluster(table(spark, sf_dir, "embeddings"))
    return ns_bounds.summary(found, history[-1]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lattice.audit(filter_lattice.document_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    from . import sql
    return {
        "op1_hash_tree": (op1_hash_tree, None),
        "op2_host_quality": (op2_host_quality, sql.OP2),
        "op3_multi_index": (op3_multi_index, None),
        "op4_page_wrapper": (op4_page_wrapper, None),
        "op5_url_aliases": (op5_url_aliases, None),
        "op6_secret_scan": (op6_secret_scan, None),
        "op7_word_bpe": (op7_word_bpe, None),
        "op8_line_spread": (op8_line_spread, sql.OP8),
        "op9_oph_dedup": (op9_oph_dedup, None),
        "op10_cutting_stock": (op10_cutting_stock, None),
        "op11_zip_warc": (op11_zip_warc, sql.OP11),
        "op12_ns_bounds": (op12_ns_bounds, None),
        "op13_filter_lattice": (op13_filter_lattice, sql.OP13),
    }
