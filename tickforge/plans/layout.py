"""Skew-safe series layout: every symbol split into row-bounded blocks.

A window keyed by symbol alone puts a whole symbol in one task; if one symbol
holds a third of all rows, that task holds a third of the data. Instead every
series window here is keyed by ``(symbol, _blk)``:

1. rows are range-partitioned and sorted by (symbol, time), ties broken by a
   digest of the row and a seeded draw, so that equal times, too, are spread
   over partitions; the sorted rows are written once to the shared folder;
2. a row's place in its partition plus the rows of its symbol in the
   partitions before it is ``_rn``, the exact 1-based row number of the bar
   inside its symbol. The offsets are one row per (symbol, partition);
3. block k of a symbol is rows k * block_rows + 1 to (k + 1) * block_rows,
   whatever the times are;
4. the last ``halo`` rows of each block are also copied into the next block
   (``_own = false``) so that every look-back of up to ``halo`` rows is
   answered inside one block; halo rows are dropped at the end.

Row-frame windows (lag, rolling n, EMA by doubling) are then exact inside a
block; cumulative quantities add a carry computed on the small block table
(:func:`add_carry`). No block holds more than block_rows + halo rows. The offsets
are broadcast only after their row count is checked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SYM, TS
from ..session import scratch_path

BLK, RN, OWN, ORD, SUB = "_blk", "_rn", "_own", "_ord", "_sub"
LAYOUT_COLS = (BLK, RN, OWN, ORD, SUB)
# rows per sub-block of the closed-form recurrence kernel (see kernels.py)
SUB_ROWS = 1024

# Plan tables up to this many rows are broadcast; above it they are joined
# with a shuffle.
BROADCAST_ROWS = 2_000_000
DEFAULT_BLOCK_ROWS = 1 << 20
#: Rows of a task, about, where a table is too large for the session's partitions.
TASK_ROWS = 500_000
#: Spark's setting to remove the shuffle files of a query when it ends.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Laid:
    """A laid-out series frame plus what the kernels need to know about it."""
    df: DataFrame
    sym: str
    ts: str
    halo: int
    blocked: bool
    blocks: DataFrame | None = None  # (sym, _blk, _start): one row per block

    def with_df(self, df: DataFrame) -> "Laid":
        return Laid(df, self.sym, self.ts, self.halo, self.blocked, self.blocks)


def series_window(sym: str = SYM):
    # ordered by (sub-block, row number): the one sort that also serves the
    # sub-block partitions of the recurrence kernel
    # (partitionBy(sym, _blk, _sub).orderBy(_rn))
    return Window.partitionBy(sym, BLK).orderBy(SUB, RN)


def _number(df: DataFrame, sym: str) -> DataFrame:
    w = Window.partitionBy(sym, BLK).orderBy(ORD)
    return _sub_blocks(df.withColumn(RN, F.row_number().over(w).cast("bigint")))


def _sub_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn(SUB, F.floor((F.col(RN) - 1) / SUB_ROWS).cast("bigint"))


def rows(sym: str, n: int):
    """Frame of the current row and the n-1 rows before it."""
    return series_window(sym).rowsBetween(-(n - 1), 0)


def cumulative(sym: str):
    return series_window(sym).rowsBetween(Window.unboundedPreceding, 0)


def maybe_broadcast(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a small table only when its counted size is under the limit."""
    return F.broadcast(df) if n_rows <= limit else df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row statistics table (means, fences,
    fitted scales) to every row as typed literals: one tiny job reads the
    row; no join of any kind is planned."""
    row = one_row.first()
    return df.withColumns({
        f.name: F.lit(None if row is None else row[f.name]).cast(f.dataType)
        for f in one_row.schema.fields})


def key_count(df: DataFrame, *keys: str) -> int:
    """Distinct keys of an input (e.g. symbols): the row bound of every
    per-key table derived from it, so those tables can be broadcast-checked
    without running the pipeline that produces them."""
    return df.select(*keys).distinct().count()


def stored(df: DataFrame, name: str, let_go: bool = False) -> DataFrame:
    """A written table in the shared folder: what follows starts from its files.

    With ``let_go`` the write's shuffle files go as soon as it is done, not with the next
    collection of the driver's memory: no plan but the write's own has them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(LET_GO, None)
    try:
        if let_go:
            spark.conf.set(LET_GO, "true")
        df.write.parquet(path)
    finally:
        if let_go:
            spark.conf.unset(LET_GO) if before is None else spark.conf.set(LET_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_parts(df: DataFrame, name: str, part_rows: int = TASK_ROWS) -> DataFrame:
    """``stored`` for rows that a fit keeps as objects: no partition holds more than about ``part_rows``.

    A scan deals files out by bytes, some million rows of a narrow table to a task; where
    that makes fewer partitions than wanted, rows are dealt once more and checkpointed.
    """
    out = stored(df, name)
    parts = math.ceil(out.count() / part_rows)
    return out if parts <= out.rdd.getNumPartitions() else _materialize(out.repartition(parts))


def _materialize(df: DataFrame) -> DataFrame:
    # Small plan table: computed once, reliable checkpoint in the shared folder.
    return df.checkpoint(eager=True)


def series_sizes(df: DataFrame, sym: str = SYM) -> tuple[int, int]:
    """Row count of the longest symbol, and of all (one small aggregate job)."""
    n = df.groupBy(sym).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return int(n[0] or 0), int(n[1] or 0)


def _dealt(df: DataFrame, total: int, task_rows: int, *keys: str) -> DataFrame:
    """Rows of a large table by ``keys`` in as many partitions as its size asks for.

    Adaptive execution only joins the session's fixed number of partitions, so a task
    would grow with the table. Smaller tables are left to it."""
    parts = math.ceil(total / task_rows)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def lay_out(df: DataFrame, sym: str = SYM, ts: str = TS, *, halo: int = 0,
            blocked: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS,
            largest: int | None = None, total: int = 0, task_rows: int = TASK_ROWS) -> Laid:
    """Attach ``_blk``, ``_rn`` and ``_own`` to a bar-like table.

    ``halo`` is the longest look-back (in rows) any later window needs.
    Rows with a null symbol or order key belong to no series and are left out.
    ``blocked=False`` gives the plain layout (one block per symbol); it is
    also chosen automatically when no symbol has more than ``block_rows``
    rows, since one block per symbol is then already bounded. The blocked
    path is tested against it with small ``block_rows``.
    """
    halo = max(int(halo), 0)
    # a row without symbol or order key has no place in a series (at any size)
    df = df.where(F.col(sym).isNotNull() & F.col(ts).isNotNull())
    if not blocked:
        out = _dealt(df, total, task_rows, sym)
        out = out.withColumns({BLK: F.lit(0).cast("bigint"), OWN: F.lit(True), ORD: F.col(ts)})
        return Laid(_number(out, sym), sym, ts, halo, False, None)

    # 0. one small aggregate: if every symbol fits in one block, one block per
    #    symbol is already bounded and the plan below is not needed.
    if largest is None:
        largest, total = series_sizes(df, sym)
    if int(largest) <= max(int(block_rows), halo + 1):
        return lay_out(df, sym, ts, halo=halo, blocked=False, total=total, task_rows=task_rows)
    block_rows = max(int(block_rows), halo + 1)  # a halo lies in one block
    ranked, totals = rank(df, sym, ts)
    blocks = totals.select(sym, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_rk_n") - 1) / block_rows))).alias(BLK))
    blocks = _materialize(blocks.withColumn("_start", F.col(BLK) * block_rows))
    at = F.floor((F.col(RN) - 1) / block_rows).cast("bigint")
    here = F.struct(at.alias("b"), F.lit(True).alias("o"))
    after = F.struct((at + 1).alias("b"), F.lit(False).alias("o"))
    copied = ((F.col(RN) - 1) % block_rows >= block_rows - halo) & ((at + 1) * block_rows < F.col("_rk_n"))
    wanted = df.columns
    laid = ranked.select(*wanted, F.col(ts).alias(ORD), RN,
                         F.inline(F.when(copied, F.array(here, after)).otherwise(F.array(here))))
    laid = _sub_blocks(laid.withColumnRenamed("b", BLK).withColumnRenamed("o", OWN))
    laid = _dealt(laid, total, task_rows, sym, BLK)
    return Laid(laid, sym, ts, halo, True, blocks)


def rank(df: DataFrame, sym: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their exact number ``_rn`` in the symbol and its rows ``_rk_n``; and (symbol, _rk_n).

    Order is by ``ts``, ties by a digest of the whole row (rows that are equal
    throughout, by a seeded draw). Sorting is by ranges of (symbol, ts, tie), so a
    symbol or a time that most rows share is many partitions.
    """
    spark = df.sparkSession
    tie, draw, place = "_rk_tie", "_rk_draw", "_rk_place"
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    keyed = df.withColumn(tie, F.xxhash64(*plain)).withColumn(draw, F.rand(7))
    keys = [sym, ts, tie, draw]
    path = scratch_path(spark, "ranked")
    keyed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie, draw)
    # the id holds the partition above bit 33 and the place in it below
    keyed.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(place, T.LongType())])).parquet(path)
    part = F.shiftright(place, 33)
    ends = stored.groupBy(sym, part.alias("_rk_part")).agg(F.min(place).alias("_rk_low"), F.count(F.lit(1)).alias("_rk_c"))
    ends = _materialize(ends)  # a row for each partition and symbol in it
    w = Window.partitionBy(sym)
    before = F.sum("_rk_c").over(w.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_rk_before", F.coalesce(before, F.lit(0))).withColumn("_rk_n", F.sum("_rk_c").over(w))
    n_ends = ends.count()
    totals = ends.select(sym, "_rk_n").distinct()
    offsets = maybe_broadcast(ends.select(sym, "_rk_part", "_rk_low", "_rk_before", "_rk_n"), n_ends)
    ranked = (stored.withColumn("_rk_part", part).join(offsets, [sym, "_rk_part"])
              .withColumn(RN, F.col("_rk_before") + F.col(place) - F.col("_rk_low") + 1))
    return ranked.select(*df.columns, RN, "_rk_n"), totals


def add_carry(laid: Laid, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Finish block-local cumulative columns with the carry of earlier blocks.

    ``specs`` maps an output column to ``(local_column, kind)`` where kind is
    ``sum`` / ``max`` / ``min`` / ``last`` (last non-null) / ``next`` (first
    non-null at or after the row, i.e. a backward fill) / ``day_sum`` (a
    sum that starts anew each calendar day) / ``sum_over_last`` (see _ratio_carry). The
    local column must be cumulative over the block's own rows only. Output keeps own rows.
    """
    df = laid.df.where(F.col(OWN))
    if not laid.blocked:
        return df.withColumns({out: F.col(loc if isinstance(loc, str) else loc[0])
                               for out, (loc, _) in specs.items()})
    sym = laid.sym
    days = {out: loc for out, (loc, kind) in specs.items() if kind == "day_sum"}
    if days:
        df = _day_carry(df, sym, days)
    ratios = {out: loc for out, (loc, kind) in specs.items() if kind == "sum_over_last"}
    for out, loc in ratios.items():
        df = _ratio_carry(df, sym, out, *loc)
    specs = {out: v for out, v in specs.items() if out not in days and out not in ratios}
    if not specs:
        return df
    # block summaries: the local value on the block's last own row
    # ("next" = first non-null in later blocks: the local value on the first row)
    aggs = [(F.min_by if kind == "next" else F.max_by)(F.col(loc), F.col(RN)).alias(f"_e_{i}")
            for i, (loc, kind) in enumerate(specs.values())]
    ends = df.groupBy(sym, BLK).agg(*aggs)
    wk = Window.partitionBy(sym).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for i, (out, (loc, kind)) in enumerate(specs.items()):
        e = F.col(f"_e_{i}")
        if kind == "sum":
            c = F.sum(e).over(wk)
        elif kind == "max":
            c = F.max(e).over(wk)
        elif kind == "min":
            c = F.min(e).over(wk)
        elif kind == "last":
            c = F.last(e, ignorenulls=True).over(wk)
        elif kind == "next":
            later = Window.partitionBy(sym).orderBy(BLK).rowsBetween(1, Window.unboundedFollowing)
            c = F.first(e, ignorenulls=True).over(later)
        else:
            raise ValueError(f"unknown carry kind {kind}")
        carry_cols.append(c.alias(f"_c_{i}"))
    carry = ends.select(sym, BLK, *carry_cols)
    n_blocks = laid.blocks.count() if laid.blocks is not None else BROADCAST_ROWS + 1
    out = df.join(maybe_broadcast(carry, n_blocks), [sym, BLK], "left")
    new = {}
    for i, (name, (loc, kind)) in enumerate(specs.items()):
        c, x = F.col(f"_c_{i}"), F.col(loc)
        if kind == "sum":
            new[name] = F.coalesce(c, F.lit(0)) + x
        elif kind == "max":
            new[name] = F.greatest(c, x)
        elif kind == "min":
            new[name] = F.least(c, x)
        else:
            new[name] = F.coalesce(x, c)
    out = out.withColumns(new)
    return out.drop(*[f"_c_{i}" for i in range(len(specs))])


def _day_carry(df: DataFrame, sym: str, days: dict[str, str]) -> DataFrame:
    """Add what a day's earlier blocks have summed: a row per (symbol, day, block) is joined back."""
    day = F.to_date(ORD)
    ends = df.groupBy(sym, BLK, day.alias("_day")).agg(
        *[F.max_by(loc, RN).alias(f"_e_{out}") for out, loc in days.items()])
    before = (Window.partitionBy(sym, "_day").orderBy(BLK)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(sym, BLK, "_day", *[F.sum(f"_e_{out}").over(before).alias(f"_c_{out}") for out in days])
    df = df.withColumn("_day", day).join(carry, [sym, BLK, "_day"], "left")
    df = df.withColumns({out: F.coalesce(F.col(f"_c_{out}"), F.lit(0.0)) + F.col(loc) for out, loc in days.items()})
    return df.drop("_day", *[f"_c_{out}" for out in days])


def _ratio_carry(df: DataFrame, sym: str, out: str, known: str, waiting: str, divisor: str) -> DataFrame:
    """A running sum of terms that are divided by the last non-null divisor.

    ``known`` sums the terms whose divisor the block itself holds, ``waiting`` the
    numerators before the block's first divisor (they take the last one of earlier
    blocks), ``divisor`` is the running last one. One row per block is joined back.
    """
    ends = df.groupBy(sym, BLK).agg(*[F.max_by(c, RN).alias(n) for c, n in (
        (known, "_a"), (waiting, "_b"), (divisor, "_r"))])
    before = Window.partitionBy(sym).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_R", F.last("_r", ignorenulls=True).over(before))
    late = F.coalesce(F.try_divide("_b", "_R"), F.lit(0.0))
    ends = ends.withColumn("_C", F.sum(F.col("_a") + late).over(before))
    df = df.join(ends.select(sym, BLK, "_R", "_C"), [sym, BLK], "left")
    here = F.coalesce(F.try_divide(F.col(waiting), F.col("_R")), F.lit(0.0))
    return df.withColumn(out, F.coalesce("_C", F.lit(0.0)) + F.col(known) + here).drop("_R", "_C")


def finish(laid: Laid, keep_layout: bool = False) -> DataFrame:
    """Own rows only; drop the layout columns unless asked to keep them."""
    df = laid.df.where(F.col(OWN))
    return df if keep_layout else df.drop(*LAYOUT_COLS)


def own_only(col: Column) -> Column:
    """Value on own rows, null on halo copies (for block-local cumulative sums)."""
    return F.when(F.col(OWN), col)
