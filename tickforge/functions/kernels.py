"""Window kernels every indicator is made of (all JVM-side built-ins).

They work on a frame laid out by :func:`tickforge.plans.layout.lay_out`
(window = ``partitionBy(symbol, _blk).orderBy(_rn)``), so look-backs up to the
layout's halo are exact and no window is keyed by symbol alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layout import (BLK, RN, SUB, SUB_ROWS, OWN, cumulative, own_only, rows,
                            series_window, stored)
from ..schema import SYM


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x, n: int = 1, sym: str = SYM) -> Column:
    return F.lag(c(x), n).over(series_window(sym))


def lead(x, n: int = 1, sym: str = SYM) -> Column:
    # Only valid inside a block; forward shifts across blocks use shift_forward().
    return F.lead(c(x), n).over(series_window(sym))


def diff(x, n: int = 1, sym: str = SYM) -> Column:
    return c(x) - lag(x, n, sym)


def pct_change(x, n: int = 1, sym: str = SYM) -> Column:
    return F.try_divide(c(x), lag(x, n, sym)) - F.lit(1.0)


def rolling(fn, x, n: int, sym: str = SYM, full: bool = False) -> Column:
    """``fn`` over the last n rows; ``full`` = null until n non-null values."""
    frame = rows(sym, n)
    val = fn(c(x)).over(frame)
    if full:
        return F.when(F.count(c(x)).over(frame) == n, val)
    return val


def rolling_mean(x, n, sym=SYM, full=False):
    return rolling(F.avg, x, n, sym, full)


def rolling_sum(x, n, sym=SYM, full=False):
    return rolling(F.sum, x, n, sym, full)


def rolling_std(x, n, sym=SYM, full=False):
    return rolling(F.stddev_samp, x, n, sym, full)


def rolling_max(x, n, sym=SYM, full=False):
    return rolling(F.max, x, n, sym, full)


def rolling_min(x, n, sym=SYM, full=False):
    return rolling(F.min, x, n, sym, full)


def rolling_means(df: DataFrame, x, windows: dict[str, int], sym: str = SYM) -> DataFrame:
    """``df`` with a full-window mean (null until n non-null values) for each name of ``windows``.

    A sliding frame adds up n values for every row. Here sums of 2, 4, 8, ... rows come from
    one another by a lag, and a window is the sum of its powers of two: some log2(n) lags a
    row, no difference of running sums. Nulls count as 0; a window that reaches
    over one, or before the first row, is null.
    """
    rn, place = F.col(RN), series_window(sym)
    gap, empty = F.when(c(x).isNull(), rn), F.lit(0).cast("bigint")
    power = {1: "_rm1"}
    df = df.withColumns({"_rm1": F.coalesce(c(x).cast("double"), F.lit(0.0)),
                         "_rmgap": F.coalesce(F.max(gap).over(cumulative(sym)), empty)})
    done = {out: (1, "_rm1") for out, n in windows.items() if n % 2}  # rows covered, their sum
    size = 1
    while size * 2 <= max(windows.values()):
        size, half = size * 2, size
        power[size] = f"_rm{size}"
        new = {power[size]: F.col(power[half]) + F.lag(power[half], half).over(place)}
        df = df.withColumns(new)
        adds = {}
        for out, n in windows.items():
            if n & size:
                covered, name = done.get(out, (0, None))
                if name is None:
                    done[out] = (size, power[size])
                    continue
                adds[f"_rs_{out}_{size}"] = F.col(name) + F.lag(power[size], covered).over(place)
                done[out] = (covered + size, f"_rs_{out}_{size}")
        if adds:
            df = df.withColumns(adds)
    df = df.withColumns({out: F.when(rn - F.col("_rmgap") >= n, F.col(done[out][1]) / n) for out, n in windows.items()})
    return df.drop(*[col for col in df.columns if col.startswith(("_rm", "_rs_"))])


# Block-local cumulative parts; finish with layout.add_carry(kind=...).
def local_cumsum(x, sym=SYM) -> Column:
    return F.sum(own_only(c(x))).over(cumulative(sym))


def local_cummax(x, sym=SYM) -> Column:
    return F.max(own_only(c(x))).over(cumulative(sym))


def local_cummin(x, sym=SYM) -> Column:
    return F.min(own_only(c(x))).over(cumulative(sym))


def local_ffill(x, sym=SYM) -> Column:
    return F.last(own_only(c(x)), ignorenulls=True).over(cumulative(sym))


def local_bfill(x, sym=SYM) -> Column:
    following = series_window(sym).rowsBetween(0, Window.unboundedFollowing)
    return F.first(own_only(c(x)), ignorenulls=True).over(following)


# ---------------------------------------------------------------------------
# Linear recurrence (EMA / Wilder) by radix-4 doubling.
#
#   y_t = b_t + r * y_{t-1}  (t >= seed),  y = null before the seed
#
# equals sum_{j>=0} r^j b_{t-j}. Terms with r^j < 1e-17 cannot change a
# double, so the sum is exact to double precision after M = ln(1e-17)/ln(r)
# terms. It is built in passes S <- sum_{i<k} r^(c*i) * lag(S, c*i) where c
# is the span already covered and k <= 4 (M <= 4096 needs at most six
# passes). Radix 4 balances the two costs measured on 530k bars: each window
# operator costs about as much as three lag functions, and a lag costs per
# row. No per-row Python, no quadratic array fold, and blocks of one symbol
# run in parallel (halo >= covered span). The suite evaluates the passes of
# every indicator at the same dependency level together (lock-step).
# ---------------------------------------------------------------------------
_EPS = 1e-17
RADIX = 4


def _terms(r: float) -> int:
    if r <= 0.0:
        return 1
    if r >= 1.0:
        raise ValueError("decay must be < 1")
    return max(1, math.ceil(math.log(_EPS) / math.log(r)))


def radix_plan(r: float) -> list[int]:
    """Radix of each pass; their product is the number of terms covered."""
    need, cov, plan = _terms(r), 1, []
    while cov < need:
        k = min(RADIX, math.ceil(need / cov))
        plan.append(k)
        cov *= k
    return plan


# ---------------------------------------------------------------------------
# Closed form per sub-block (used when it is exact in double range).
#
# With j the position inside a sub-block of B = SUB_ROWS rows,
#   y_t = r^j * sum_{i<=j} r^-i b_i  +  r^(j+1) * Y_prev,
# where Y_prev is y at the end of the previous sub-block. The sum is one
# running-sum window over partitionBy(symbol, _blk, _sub); Y_prev is the
# local value at the previous sub-block end (its own carry is r^B times
# smaller, below 1e-17 when r^B < 1e-17), found with one running "last"
# window. Valid when r^-(B-1) stays far inside double range and r^B < 1e-17:
# EMA spans 4..52 and Wilder windows 3..26 -- every default of the suite.
# Needs 2B-1 rows of look-back (the previous sub-block must be complete).
# ---------------------------------------------------------------------------
_MAX_EXP = 600.0  # ln of the largest factor r^-j allowed (1e260)


def closed_form_ok(r: float) -> bool:
    if not 0.0 < r < 1.0:
        return False
    lr = -math.log(r)
    return lr * (SUB_ROWS - 1) <= _MAX_EXP and r ** SUB_ROWS < _EPS


def recurrence_lookback(r: float) -> int:
    if closed_form_ok(r):
        return 2 * SUB_ROWS - 1
    return math.prod(radix_plan(r)) - 1


def ema_lookback(span: int) -> int:
    return recurrence_lookback(1.0 - 2.0 / (span + 1.0))


def wilder_lookback(n: int) -> int:
    return recurrence_lookback((n - 1.0) / n) + n + 1


def apply_recurrences(df: DataFrame, specs, sym: str = SYM, gaps: bool = False, blocked: bool = False) -> DataFrame:
    """Evaluate several independent recurrences in lock-step.

    ``specs``: list of ``(out, b, r, seed_mask)`` where ``b`` is the input
    term column, ``r`` the decay and ``seed_mask`` a boolean column true on
    rows at or after the seed (the output is null elsewhere). Pass ``p`` of
    every recurrence shares one window operator. With ``gaps`` (an input has
    nulls) EMAs go by ``apply_weighted``, which gives the same without nulls.
    """
    if gaps:  # weights differ from row to row
        weighted = [sp for sp in specs if isinstance(sp, EmaSpec)]
        df = apply_weighted(df, weighted, sym, blocked) if weighted else df
        specs = [sp for sp in specs if not isinstance(sp, EmaSpec)]
    if not specs:
        return df
    closed = [sp for sp in specs if closed_form_ok(sp[2])]
    df = _apply_closed_form(df, closed, sym)
    specs = [sp for sp in specs if not closed_form_ok(sp[2])]
    if not specs:
        return df
    w = series_window(sym)
    tmp = {}
    init = {}
    for i, (out, b, r, seed) in enumerate(specs):
        name = f"_rec{i}_{out}"
        tmp[out] = (name, r, seed, radix_plan(r))
        init[name] = F.when(seed, c(b)).otherwise(F.lit(0.0)).cast("double")
    df = df.withColumns(init)
    n_pass = max(len(v[3]) for v in tmp.values())
    covered = {out: 1 for out in tmp}
    for p in range(n_pass):
        upd = {}
        for out, (name, r, _seed, plan) in tmp.items():
            if p >= len(plan):
                continue
            cov = covered[out]
            terms = [F.col(name)] + [F.lit(r ** (cov * i)) * F.lag(F.col(name), cov * i, 0.0).over(w)
                                     for i in range(1, plan[p])]
            acc = terms[0]
            for t in terms[1:]:
                acc = acc + t
            upd[name] = acc
            covered[out] = cov * plan[p]
        df = df.withColumns(upd)
    final = {out: F.when(seed, F.col(name)) for out, (name, _r, seed, _p) in tmp.items()}
    return df.withColumns(final).drop(*[v[0] for v in tmp.values()])


def _apply_closed_form(df: DataFrame, specs, sym: str) -> DataFrame:
    if not specs:
        return df
    j = (F.col(RN) - 1 - F.col(SUB) * SUB_ROWS).cast("double")  # 0..B-1 in the sub-block
    in_sub = (Window.partitionBy(sym, BLK, SUB).orderBy(RN)
              .rowsBetween(Window.unboundedPreceding, 0))
    before = series_window(sym).rowsBetween(Window.unboundedPreceding, -1)
    is_end = j == float(SUB_ROWS - 1)
    local, final = {}, {}
    for i, (out, b, r, seed) in enumerate(specs):
        lr = math.log(r)
        term = F.when(seed, c(b)).otherwise(F.lit(0.0)).cast("double") * F.exp(-j * lr)
        local[f"_cf{i}"] = F.exp(j * lr) * F.sum(term).over(in_sub)
    df = df.withColumns(local)
    carries = {f"_cc{i}": F.last(F.when(is_end, F.col(f"_cf{i}")), ignorenulls=True).over(before)
               for i in range(len(specs))}
    df = df.withColumns(carries)
    for i, (out, b, r, seed) in enumerate(specs):
        y = F.col(f"_cf{i}") + F.exp((j + 1.0) * math.log(r)) * F.coalesce(F.col(f"_cc{i}"),
                                                                          F.lit(0.0))
        final[out] = F.when(seed, y)
    df = df.withColumns(final)
    return df.drop(*[f"_cf{i}" for i in range(len(specs))], *[f"_cc{i}" for i in range(len(specs))])


class EmaSpec(tuple):
    """A recurrence spec that also knows its input and weight, for inputs with gaps."""
    x: Column
    alpha: float


def ema_spec(out: str, x, span: int, seed_rn: int = 1):
    """pandas ``ewm(span, adjust=False).mean()`` seeded at row ``seed_rn`` (with gaps: at the first value)."""
    if span < 1:
        raise ValueError("span must be >= 1")
    alpha = 2.0 / (span + 1.0)
    r = 1.0 - alpha
    rn = F.col(RN)
    b = F.when(rn == seed_rn, c(x)).otherwise(F.lit(alpha) * c(x))
    spec = EmaSpec((out, b, r, rn >= seed_rn))
    spec.x, spec.alpha = c(x).cast("double"), alpha
    return spec


def apply_weighted(df: DataFrame, specs: list[EmaSpec], sym: str = SYM, blocked: bool = False) -> DataFrame:
    """EMAs of inputs with nulls, with the weights of pandas' ``ewm(adjust=False)``.

    The first value is the seed; a null row repeats the mean; a value g rows after
    the last one counts alpha against (1 - alpha)**g for the mean so far. Each row
    is then an affine map y -> A y + B with a weight of its own, and maps
    compose: inside a sub-block by running sums of log A, over sub-blocks by
    composing one map each (an array of at most a block's sub-blocks), over
    blocks likewise. Nothing is cut off, so a mean survives any gap. Halo rows
    take the values of the rows they copy. Rows are written to the shared folder
    before they are joined with what is summed up from them.
    """
    before = series_window(sym).rowsBetween(Window.unboundedPreceding, -1)
    rn, drop = F.col(RN), []
    x, seen, sub, log_a, level, part, entry = ([f"_g{k}{i}" for i in range(len(specs))] for k in "xpsalce")
    sizes = [SUB_ROWS if spec.alpha >= 1 else max(1, min(SUB_ROWS, int(_MAX_EXP / -math.log(1.0 - spec.alpha)))) for spec in specs]
    df = df.withColumns({x[i]: F.when(F.col(OWN), spec.x) for i, spec in enumerate(specs)})
    df = df.withColumns({seen[i]: F.last(F.when(F.col(x[i]).isNotNull(), rn), ignorenulls=True).over(before)
                         for i in range(len(specs))})
    if blocked:
        df = stored(df, "means-seen")
        last = df.groupBy(sym, BLK).agg(*[F.max(F.when(F.col(c).isNotNull(), rn)).alias(f"_f{c}") for c in x])
        earlier = Window.partitionBy(sym).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
        df = df.join(last.select(sym, BLK, *[F.max(f"_f{c}").over(earlier).alias(f"_f{c}") for c in x]), [sym, BLK])
        df = df.withColumns({seen[i]: F.coalesce(seen[i], f"_f{x[i]}") for i in range(len(specs))})
        df = df.drop(*[f"_f{c}" for c in x])
    for i, spec in enumerate(specs):
        r = 1.0 - spec.alpha
        gap, here = rn - F.col(seen[i]), F.col(x[i]).isNotNull()
        kept = F.pow(F.lit(r), gap.cast("double"))
        follows = here & F.col(seen[i]).isNotNull()
        df = df.withColumn(sub[i], F.floor((rn - 1) / sizes[i]))
        in_sub = Window.partitionBy(sym, BLK, sub[i]).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
        if r > 0:
            term = F.when(follows, F.lit(spec.alpha) * F.col(x[i]) / (kept + spec.alpha)).when(here, F.col(x[i])).otherwise(0.0)
            # a factor under e**-60 is nothing beside the value it stands next to
            log_of = F.greatest(gap * math.log(r) - F.log(kept + spec.alpha), F.lit(-60.0))
            df = df.withColumn(log_a[i], F.when(follows, log_of).otherwise(0.0))
            df = df.withColumn(level[i], F.sum(log_a[i]).over(in_sub))
            df = df.withColumn(part[i], F.exp(level[i]) * F.sum(term * F.exp(-F.col(level[i]))).over(in_sub))
            df = df.withColumn(level[i], F.exp(level[i]))  # the factor of the mean before
        else:  # a value forgets all before it
            df = df.withColumn(part[i], F.last(x[i], ignorenulls=True).over(in_sub))
            df = df.withColumn(level[i], F.when(F.col(part[i]).isNull(), 1.0).otherwise(0.0))
            df = df.withColumn(part[i], F.coalesce(part[i], F.lit(0.0)))
        drop += [x[i], seen[i], sub[i], log_a[i], level[i], part[i], entry[i]]
    df = out = stored(df, "means-maps")
    for i, spec in enumerate(specs):
        ends = df.where(F.col(OWN)).groupBy(sym, BLK, sub[i]).agg(
            F.max_by(level[i], rn).alias("_A"), F.max_by(part[i], rn).alias("_B"))
        out = out.join(_entries(ends, sym, sub[i], entry[i], blocked), [sym, BLK, sub[i]], "left")
    values = {spec[0]: F.when((F.col(x[i]).isNotNull() | F.col(seen[i]).isNotNull()) & F.col(OWN),
                              F.col(part[i]) + F.col(level[i]) * F.coalesce(entry[i], F.lit(0.0)))
              for i, spec in enumerate(specs)}
    out = out.withColumns(values).drop(*drop)
    if blocked:
        names = list(values)
        own = out.where(F.col(OWN)).select(sym, RN, *[F.col(n).alias(f"_o{n}") for n in names])
        out = out.drop(*names).join(own, [sym, RN], "left").withColumnsRenamed({f"_o{n}": n for n in names})
    return out


def _entries(ends: DataFrame, sym: str, sub: str, out: str, blocked: bool) -> DataFrame:
    """The mean with which each sub-block begins, from the maps (_A, _B) of sub-blocks in order."""
    def scan(maps, label):
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"),
                         F.array().cast(f"array<struct<at:bigint,a:double,b:double>>").alias("list"))
        step = lambda acc, m: F.struct(
            (m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b"),
            F.concat(acc["list"], F.array(F.struct(m["at"].alias("at"), acc["a"].alias("a"), acc["b"].alias("b")))).alias("list"))
        return F.aggregate(F.sort_array(maps), start, step).alias(label)

    one = F.collect_list(F.struct(F.col(sub).alias("at"), F.col("_A").alias("a"), F.col("_B").alias("b")))
    inside = ends.groupBy(sym, BLK).agg(one.alias("_maps")).select(sym, BLK, scan(F.col("_maps"), "_in"))
    flat = inside.select(sym, BLK, F.explode("_in.list").alias("_m"))
    if not blocked:  # one block a symbol: it begins from nothing
        return flat.select(sym, BLK, F.col("_m.at").alias(sub), F.col("_m.b").alias(out))
    whole = inside.groupBy(sym).agg(F.collect_list(F.struct(
        F.col(BLK).alias("at"), F.col("_in.a").alias("a"), F.col("_in.b").alias("b"))).alias("_maps"))
    starts = whole.select(sym, F.explode(scan(F.col("_maps"), "_s")["list"]).alias("_t")).select(
        sym, F.col("_t.at").alias(BLK), F.col("_t.b").alias("_from"))
    return flat.join(starts, [sym, BLK]).select(
        sym, BLK, F.col("_m.at").alias(sub), (F.col("_m.a") * F.col("_from") + F.col("_m.b")).alias(out))


def wilder_spec(out: str, x, n: int, seed_rn: int, seed_value, scale_by_n: bool = True):
    """Wilder smoothing: y_seed = seed_value; y_t = y_{t-1}(n-1)/n + x_t/n.

    With ``scale_by_n=False`` it is Wilder's running *sum*:
    y_t = y_{t-1}(n-1)/n + x_t.
    """
    r = (n - 1.0) / n
    rn = F.col(RN)
    k = (1.0 / n) if scale_by_n else 1.0
    b = F.when(rn == seed_rn, c(seed_value)).otherwise(F.lit(k) * c(x))
    return (out, b, r, rn >= seed_rn)


def rnd(x, digits: int = 6) -> Column:
    return F.round(c(x), digits)

