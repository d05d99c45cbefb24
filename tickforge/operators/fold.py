"""Path-dependent folds (state that branches on itself): Parabolic SAR, the action ledger.

A series of one block is a grouped map: Spark hands the function an iterator of
Arrow batches in ``(symbol, ts)`` order and the fold carries only its small state
from batch to batch. A longer one is cut into blocks by exact rank, and all blocks
run at once from *guessed* entry states (:func:`fold_blocks`); blocks whose
entry turns out to be another (the exit of the block before) run again, until
no entry changes. Such a fold forgets: after a reversal, two runs of a stop
agree, so few blocks run twice. Where a fold does not forget (a ledger's
balance), only the first wrong block of each series runs again, so the work
stays in proportion, block by block.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import BLK, DEFAULT_BLOCK_ROWS, RN, maybe_broadcast, rank, stored
from ..schema import SYM, TS


#: Rows of short series, about, that one Python group takes.
GROUP_ROWS = 20_000


def _check_order(prev_ts, ts_values):
    if len(ts_values) == 0:
        return prev_ts
    arr = ts_values.to_numpy()
    if (prev_ts is not None and arr[0] <= prev_ts) or (len(arr) > 1 and (np.diff(arr).astype(
            "int64") <= 0).any()):
        raise RuntimeError("grouped fold received rows out of time order")
    return arr[-1]


class StopAndReverse:
    """The state of a parabolic stop: one step for both sides.

    Everything is kept in the direction of the trade: with side +1 (long) or
    -1 (short) a price x counts as side * x, so "better" is always larger.

    ``textbook`` is Wilder's rule: the acceleration grows on every new extreme
    and a reversal starts a new extreme. The default keeps the older series'
    rule, whose results users compare with: both sides keep their extremes for
    good, and as the running extreme is raised before the test, acceleration
    grows only on the bar of a reversal.
    """

    def __init__(self, step: float, limit: float, textbook: bool):
        self.step, self.limit, self.textbook = step, limit, textbook
        self.stop = None

    def begin(self, high: float, low: float, close: float) -> float:
        self.side, self.speed, self.stop = 1, self.step, close
        self.best = {1: high, -1: -low}
        self.last = (high, low)
        return close

    def advance(self, high: float, low: float) -> float:
        favourable, adverse = {1: high, -1: -low}, {1: low, -1: -high}
        side, best = self.side, self.best[self.side]
        level = side * self.stop
        level += self.speed * (best - level)
        self.best[side] = max(best, favourable[side])
        if self.textbook and favourable[side] > best:
            self.speed = min(self.speed + self.step, self.limit)
        if adverse[side] < level:  # the stop is hit: reverse at the extreme
            level, self.side, self.speed = -best, -side, self.step
            side = self.side
            if self.textbook:
                self.best[side] = favourable[side]
        guard = self.last[1] if side > 0 else -self.last[0]
        level = min(level, guard)
        if not self.textbook and favourable[side] > self.best[side]:
            self.speed = min(self.speed + self.step, self.limit)
        self.stop, self.last = side * level, (high, low)
        return self.stop


    def state(self) -> list[float]:
        return [float(self.side), self.speed, self.stop, self.best[1], self.best[-1], *self.last]

    def resume(self, state: list[float]) -> None:
        side, self.speed, self.stop, up, down, high, low = state
        self.side, self.best, self.last = int(side), {1: up, -1: down}, (high, low)


def _fold_batches(run, ts: str, columns: list[str], batches, state):
    """Batches of one series or block, with the fold's columns, and the state after each."""
    last_ts = None
    for pdf in batches:
        last_ts = _check_order(last_ts, pdf[ts])
        if len(pdf):
            made, state = run(state, pdf)
            yield pdf[columns].assign(**made), state


def longest_series(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _fold_many(run, keys: list[str], ts: str, columns: list[str], batches):
    """Batches of many series, one after the other, with the fold's columns; a series may go on in the next batch."""
    key, last_ts, state = None, None, None
    for pdf in batches:
        if not len(pdf):
            continue
        starts, made = np.zeros(len(pdf), dtype=bool), {}
        values = [pdf[k].to_numpy() for k in keys]
        for v in values:
            starts[1:] |= (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1]))
        cuts = [0, *np.flatnonzero(starts).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(repr(v[a]) for v in values)
            if here != key:
                key, last_ts, state = here, None, None
            part = pdf.iloc[a:b]
            last_ts = _check_order(last_ts, part[ts])
            new, state = run(state, part)
            for name, x in new.items():
                made.setdefault(name, []).extend(x)
        yield pdf[columns].assign(**made)


def fold_placed(df: DataFrame, keys: list[str], ts: str, run, fields: list[T.StructField]) -> DataFrame:
    """The fold of rows that a window by ``keys`` in the order of ``ts`` has dealt out and sorted (a wrong order is an error)."""
    columns, schema = df.columns, T.StructType(df.schema.fields + fields)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out, _ in _fold_batches(run, ts, columns, batches, None):
            yield out

    return df.groupBy(*keys).applyInPandas(whole, schema)


def fold_series(df: DataFrame, keys: list[str], ts: str, run, fields: list[T.StructField], *, guess=None,
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``df`` with the columns ``fields`` of a fold over each series in the order of ``ts``.

    ``run(state, frame)`` gives the new columns of some rows and the state (a list
    of numbers) after them; the first state is None. Rows without a key or time
    belong to no series and are left out; a repeated time is an error. Series of
    up to ``block_rows`` rows run whole, about ``GROUP_ROWS`` rows of them in one Python
    group (a group costs as much as some thousand rows), longer ones a task for each block.
    """
    for c in [*keys, ts]:
        df = df.where(F.col(c).isNotNull())
    longest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (longest or 0) > block_rows:
        return fold_blocks(df, keys, ts, run, fields, guess=guess, block_rows=block_rows)
    group, columns, schema = "_fold_group", df.columns, T.StructType(df.schema.fields + fields)
    groups = max(4 * df.sparkSession.sparkContext.defaultParallelism, (total or 0) // GROUP_ROWS)

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _fold_many(run, keys, ts, columns, batches)

    df = df.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(groups)))
    return df.repartition(group).sortWithinPartitions(group, *keys, ts).groupBy(group).applyInPandas(many, schema)


def fold_blocks(df: DataFrame, keys: list[str], ts: str, run, fields: list[T.StructField], *, guess=None,
                block_rows: int = DEFAULT_BLOCK_ROWS, seen: list | None = None) -> DataFrame:
    """The same for long series: blocks from guessed entry states, run again until every entry holds.

    ``guess(blocks, keys)`` gives rows (keys, _blk, _entry array<double>) of
    later blocks from the rows (with ``_blk`` and ``_rn``); without it, and for
    the first block, a block starts like a series. Every round is a written
    table of the rows it has run; entries and exits are one row a block. After a
    round in which most blocks left otherwise than before although only
    their entry had changed, speculation stops: then just the first wrong block of
    each series runs again. ``seen`` collects the blocks run in each round.
    """
    key = "_fold_key"
    ranked, totals = rank(df.withColumn(key, F.struct(*keys)), key, ts)
    block = F.floor((F.col(RN) - 1) / block_rows).cast("bigint")
    rows = stored(ranked.drop("_rk_n").withColumn(BLK, block), "fold-rows")
    blocks = totals.select(key, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_rk_n") - 1) / block_rows))).alias(BLK))
    none = F.lit(None).cast("array<double>")
    entries = blocks.withColumn("_entry", none)
    if guess is not None:
        entries = blocks.join(guess(rows, [key]), [key, BLK], "left").select(key, BLK, "_entry")
    entries = stored(entries, "fold-entries")
    n_blocks = entries.count()
    columns = df.columns
    out_fields = [*df.schema.fields, *fields, T.StructField(key, rows.schema[key].dataType),
                  T.StructField(BLK, T.LongType()), T.StructField("_exit", T.ArrayType(T.DoubleType()))]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        first = True
        for pdf in batches:
            if first:
                entry, first = pdf["_entry"].iloc[0], False
                state = None if entry is None else [float(x) for x in entry]
            for out, state in _fold_batches(run, ts, [*columns, key, BLK], [pdf], state):
                if held is not None:
                    yield held.assign(_exit=None)
                held = out
        if held is not None:  # the exit state stands on the block's last row
            yield held.iloc[:-1].assign(_exit=None)
            yield held.iloc[-1:].assign(_exit=[state])

    exits, tables, todo, speculate, round_ = None, [], entries, True, 0
    while True:
        n = todo.count()
        if not n:
            break
        if seen is not None:
            seen.append(n)
        part = rows.join(maybe_broadcast(todo, n), [key, BLK])
        part = part.repartition(key, BLK).sortWithinPartitions(key, BLK, RN)
        done = stored(part.groupBy(key, BLK).applyInPandas(one, T.StructType(out_fields)), "fold-round")
        tables.append(done.withColumn("_round", F.lit(round_)))
        now = done.where(F.col("_exit").isNotNull()).select(key, BLK, F.lit(round_).alias("_round"), "_exit")
        if exits is None:
            exits = now
        else:
            both = exits.join(now.withColumnsRenamed({"_round": "_r", "_exit": "_e"}), [key, BLK], "left")
            if speculate:
                again, same = both.where(F.col("_r").isNotNull()).agg(
                    F.count(F.lit(1)), F.count(F.when(F.col("_e").eqNullSafe(F.col("_exit")), 1))).first()
                speculate = 2 * same >= again
            both = both.select(key, BLK, F.coalesce("_r", "_round").alias("_round"), F.coalesce("_e", "_exit").alias("_exit"))
            exits = both
        exits = stored(exits, "fold-exits")
        before = F.lag("_exit").over(Window.partitionBy(key).orderBy(BLK))
        held = entries.join(exits, [key, BLK]).withColumn("_now", F.when(F.col(BLK) > 0, before))
        wrong = held.where(~F.col("_now").eqNullSafe(F.col("_entry"))).select(key, BLK, F.col("_now").alias("_entry"))
        if not speculate:
            first = wrong.groupBy(key).agg(F.min(BLK).alias(BLK))
            wrong = wrong.join(first, [key, BLK], "left_semi")
        todo = stored(wrong, "fold-wrong")
        entries = stored(entries.join(todo.withColumnRenamed("_entry", "_new").withColumn("_hit", F.lit(True)), [key, BLK], "left")
                          .select(key, BLK, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("_entry")).alias("_entry")), "fold-entries")
        round_ += 1
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    last = maybe_broadcast(exits.select(key, BLK, "_round"), n_blocks)
    return out.join(last, [key, BLK, "_round"]).select(*columns, *[f.name for f in fields])


def _extremes_guess(step: float):
    """Entry of a block as if long since its start, with the extremes and the last bar of all rows before it."""
    def guess(rows: DataFrame, keys: list[str]) -> DataFrame:
        ends = rows.groupBy(*keys, BLK).agg(F.max("high").alias("h"), F.min("low").alias("l"),
                                            F.max_by(F.struct("high", "low"), RN).alias("last"))
        before = Window.partitionBy(*keys).orderBy(BLK)
        so_far = before.rowsBetween(Window.unboundedPreceding, -1)
        last = F.lag("last").over(before)
        state = F.array(F.lit(1.0), F.lit(step), last["low"], F.max("h").over(so_far), -F.min("l").over(so_far),
                        last["high"], last["low"])
        return ends.select(*keys, BLK, F.when(F.col(BLK) > 0, state.cast("array<double>")).alias("_entry"))
    return guess


def psar(bars: DataFrame, sym: str = SYM, ts: str = TS, step: float = 0.02,
         max_step: float = 0.2, textbook: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Parabolic SAR per symbol, starting long at the first close (see StopAndReverse)."""
    if not (0 < step <= max_step):
        raise ValueError("need 0 < step <= max_step")
    missing = [c for c in ("high", "low", "close") if c not in bars.columns]
    if missing:
        raise ValueError(f"psar needs the columns {missing}")

    def run(state, pdf):
        stop = StopAndReverse(step, max_step, textbook)
        if state is not None:
            stop.resume(state)
        rows = zip(*(pdf[x].to_numpy(dtype="float64").tolist() for x in ("high", "low", "close")))
        made = [stop.begin(h, lo, cl) if stop.stop is None else stop.advance(h, lo) for h, lo, cl in rows]
        return {"PSAR": made}, stop.state()

    return fold_series(bars, [sym], ts, run, [T.StructField("PSAR", T.DoubleType())],
                       guess=_extremes_guess(step), block_rows=block_rows)
