"""Helpers shared by the text operators: staged tables, ranks, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path, ship_package

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
#: Most bytes of a table that is broadcast by a hint.
BROADCAST_BYTES = 64 << 20
#: Least bytes that a task writes of a staged table whose size is bounded beforehand.
FILE_BYTES = 1 << 20
#: Bytes of an edge, two long numbers.
EDGE_BYTES = 16
#: Rows of one bucket of ``gapless_rank`` (2 to this power).
RANK_BUCKET_BITS = 15


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df`` (case-insensitive)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str, most_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor. Where a value
    depends on the task that made it (row ids), this also fixes it.
    ``most_bytes`` is a bound on its size, if one is known: it is then written
    by one task for each ``FILE_BYTES`` of it at most, else by every task of
    its last stage, a file each however few the rows. On a local file system
    Hadoop starts processes for every file.
    """
    spark = df.sparkSession
    if most_bytes is not None:
        df = df.coalesce(max(1, -(-most_bytes // FILE_BYTES)))
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alternating(spark: SparkSession, name: str):
    """A function that writes a frame and reads it back, each time over the table before the last.

    For state that is replaced round by round: the table that a round reads is
    whole until the next one is written, so a failed round can start again, and
    two tables are on disk however many rounds there are.
    """
    ship_package(spark)
    paths = [scratch_path(spark, f"{name}-{i}") for i in "ab"]

    def write(df: DataFrame) -> DataFrame:
        paths.reverse()
        df.write.mode("overwrite").parquet(paths[0])
        return spark.read.schema(df.schema).parquet(paths[0])
    return write


def checked_broadcast(df: DataFrame, row_bytes) -> DataFrame:
    """A hint to broadcast a written table if its rows, measured, stay under ``BROADCAST_BYTES``.

    ``row_bytes`` is a number or a column. Beyond it Spark joins as it sees
    fit, by a shuffle.
    """
    size = df.agg(F.sum(F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def slices(batches, rows: int = 1024):
    """Arrow batches cut into parts of at most ``rows`` rows: a task holds the Python objects of one part."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_STATE: dict[str, object] = {}


def worker_state(name: str, make):
    """What a Python worker keeps from task to task, made by ``make`` at first: of one operator at a time.

    Workers live on through the stages of a job. When the next operator comes,
    the memory of the one before is given back.
    """
    if name not in _STATE:
        _STATE.clear()
        pa.default_memory_pool().release_unused()
        _STATE[name] = make()
    return _STATE[name]


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def gapless_rank(df: DataFrame, keys: list[str], rid: str, out: str) -> DataFrame:
    """Rank from 0 inside ``keys`` in the order of the row id ``rid``.

    Row ids are cut into buckets of 2**15: the window ranks inside (keys,
    bucket), and the buckets' counts, one row for each, are summed up to give
    the offset of each bucket. A key with a third of all rows is many buckets.
    """
    (b, base, local) = fresh(df, "_bucket", "_base", "_local")
    d = df.withColumn(b, F.shiftrightunsigned(F.col(rid), RANK_BUCKET_BITS))
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(local))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, b, F.coalesce(F.sum(local).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, b).orderBy(rid)
    ranked = d.withColumn(local, F.row_number().over(inside) - 1)
    joined = ranked.join(bases, [*keys, b])
    return joined.withColumn(out, F.col(base) + F.col(local)).drop(b, base, local)


def components(edges: DataFrame, left: str, right: str, name: str = "components", rows: int | None = None) -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, root), root the smallest node.

    Rows for every node that an edge names; loops and repeated edges are
    harmless, an edge with a null end is ignored. Alternates two steps until
    only stars are left: every node hands its larger neighbours, then its smaller
    ones, to the smallest neighbour. Each step groups edges by node with a
    partial minimum and joins it back (a hot node is a skewed join, which
    adaptive execution splits); each round is a written table, of twice the edges
    of the one before at most. Rounds grow with the logarithm of the longest
    path. ``rows`` is the number of ``edges``, or a bound on it, if known.
    """
    e = (edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
         .where("u is not null and v is not null"))
    own = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = staged(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct(), name, None if rows is None else EDGE_BYTES * rows)
    while True:
        done, rows = _stars(e)
        if done:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = staged(small.select("u", F.col("m").alias("v"))
                   .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                   .distinct(), name, EDGE_BYTES * 2 * rows)
    return (own.join(e, own["node"] == e["u"], "left")
            .select("node", F.coalesce("v", "node").alias("root")))


def _stars(e: DataFrame) -> tuple[bool, int]:
    """Whether edges (u, v), u > v, have one v for each u, which is no u itself, and their number: one row, three numbers."""
    ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .union(e.select("v", F.lit(0), F.lit(1)))
            .groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
    most, both, rows = ends.agg(F.max("up"), F.max(F.least("up", "down")), F.sum("up")).first()
    return not both and (most or 0) <= 1, rows or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
