"""Strategy replay, performance, risk and option-trade P&L.

The action ledger is a path-dependent fold (share count and balance branch
on themselves) per (strategy, symbol), cut into blocks like PSAR. Everything else
is aggregates and windows: performance metrics are one grouped aggregate per
symbol, running marks use the block layout's carried maxima.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..plans.layout import DEFAULT_BLOCK_ROWS, LAYOUT_COLS, RN, series_sizes, stored
from ..schema import SYM, TS
from .fold import fold_blocks, fold_placed, longest_series
from .series import run_series

INITIAL_BALANCE = 10000.0
FEE = 0.001
RF = 0.01
TRADING_DAYS = 252
#: Steps of one row of a report's step arrays.
REPORT_STEPS = 1 << 16


def action_ledger(actions: DataFrame, *, sym: str = SYM, ts: str = TS, key=None,
                  balance: float = INITIAL_BALANCE, fee: float = FEE,
                  block_rows: int = DEFAULT_BLOCK_ROWS, largest: int | None = None) -> DataFrame:
    """Replay an action table per symbol (action_type 0 = buy, 1 = sell, other
    = hold; amount in [0,1]). An action trades at its own bar's price: buy
    floor(balance / price) * amount shares at price * (1 + fee), sell shares *
    amount at price * (1 - fee). Then the replay steps to the next bar, where
    the position is valued: equity = shares * next price + balance, reward =
    equity minus the initial balance. The last bar has no next one: its action
    is taken and the position is valued at its own price. ``step_price`` is the price of the valuation. Also flags a balance
    driven below zero by fees. ``largest`` is the rows of the longest series, where known.

    Series of up to ``block_rows`` rows are dealt out and sorted once: the window that
    looks at the next price also gives the fold its order."""
    keys = [sym] + list(key or [])
    for c in [*keys, ts]:
        actions = actions.where(F.col(c).isNotNull())

    def run(state, pdf):
        bal, sh = (balance, 0.0) if state is None else state
        rows = zip(pdf["action_type"].to_numpy().tolist(), pdf["amount"].to_numpy(dtype="float64").tolist(),
                   pdf["price"].to_numpy(dtype="float64").tolist())
        b_out, s_out = [], []
        for k, a, p in rows:
            if k == 0 and p > 0:
                n = math.floor(bal / p) * a
                bal -= n * p * (1 + fee)
                sh += n
            elif k == 1:
                n = sh * a
                bal += n * p * (1 - fee)
                sh -= n
            b_out.append(bal)
            s_out.append(sh)
        return {"balance": b_out, "shares": s_out}, [bal, sh]

    fields = [T.StructField("balance", T.DoubleType()), T.StructField("shares", T.DoubleType())]
    if (longest_series(actions, keys) if largest is None else largest) > block_rows:
        out = fold_blocks(actions, keys, ts, run, fields, block_rows=block_rows)
        return _valued(out, actions, keys, ts, balance)
    after = F.lead(F.struct("price")).over(Window.partitionBy(*keys).orderBy(ts))
    out = fold_placed(actions.withColumn("_after", after), keys, ts, run, fields)
    return _account(out, actions.columns, F.coalesce(F.col("_after"), F.struct("price"))["price"], balance)


def _valued(out: DataFrame, actions: DataFrame, keys: list[str], ts: str, balance: float) -> DataFrame:
    """Equity at the next bar's price: a look-ahead inside each day of a series, across days by their first bars.

    A window over whole series would be one task for a hot symbol, so
    the look-ahead runs inside (key, day) and the last bar of a day takes the
    first price of the series' next day that has bars: one row a day.
    """
    day = F.to_date(ts)
    firsts = actions.groupBy(*keys, day.alias("_day")).agg(F.min_by(F.struct("price"), ts).alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_day")))
    inside = F.lead(F.struct("price")).over(Window.partitionBy(*keys, "_day").orderBy(ts))
    out = out.withColumn("_day", day).withColumn("_next", inside)
    out = out.join(firsts.drop("_first"), [*keys, "_day"])
    return _account(out, actions.columns, F.coalesce(F.col("_next"), F.col("_after"), F.struct("price"))["price"], balance)


def _account(out: DataFrame, columns: list[str], value, balance: float) -> DataFrame:
    equity = F.col("shares") * value + F.col("balance")
    return out.select(*columns, "balance", "shares", equity.alias("equity"),
                      (equity - balance).alias("reward"), (F.col("balance") < 0).alias("negative_balance"),
                      value.alias("step_price"))


def momentum_actions(bars: DataFrame, *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """A deterministic momentum action table from bars: buy half after an up
    bar, sell half after a down bar, else hold (the policy is the input of the
    ledger; any table with these columns works)."""
    def build(df, carries):
        d = F.col("close") - K.lag("close", 1, sym)
        return df.withColumns({
            "action_type": F.when(d > 0, 0).when(d < 0, 1).otherwise(2),
            "amount": F.lit(0.5), "price": F.col("close")})

    return run_series(bars, build, halo=1, sym=sym, ts=ts, **kw).select(
        sym, ts, "action_type", "amount", "price")


def performance(series: DataFrame, value: str | list[str] = "close", *, sym: str = SYM, ts: str = TS,
                rf: float = RF, also=(), **kw) -> DataFrame:
    """Per symbol: Sharpe and Sortino (population std, annualised by sqrt(252); null if that is 0),
    max drawdown (ratio), mean return, absolute max drawdown, volatility,
    MFE/MAE against the first value. Of several values, named ``<value>_sharpe_ratio`` and so on,
    in one pass. ``also`` are more aggregates of a symbol's rows."""
    values = [value] if isinstance(value, str) else list(value)

    def build(df, carries):
        for v in values:
            before = K.lag(v, 1, sym)
            df = df.withColumns({f"ret__{v}": F.try_divide(F.col(v) - before, before), f"_pk__{v}": K.local_cummax(v, sym)})
            carries[f"peak__{v}"] = (f"_pk__{v}", "max")
        return df

    r = run_series(series, build, halo=1, sym=sym, ts=ts, **kw)
    aggs = []
    for name in values:
        v, ret, peak = F.col(name), F.col(f"ret__{name}"), F.col(f"peak__{name}")
        ex = ret - F.lit(rf / TRADING_DAYS)
        down = F.when(ex < 0, ex)
        measures = {
            "sharpe_ratio": F.try_divide(F.avg(ex), F.stddev_pop(ex)) * F.lit(math.sqrt(TRADING_DAYS)),
            "sortino_ratio": F.try_divide(F.avg(ex), F.stddev_pop(down)) * F.lit(math.sqrt(TRADING_DAYS)),
            "max_drawdown": F.max(F.try_divide(peak - v, peak)),
            "average_return": F.avg(ret),
            "max_drawdown_abs": F.max(peak - v),
            "volatility": F.stddev_pop(ret),
            "mfe": F.max(v) - F.min_by(v, F.col(ts)),
            "mae": F.min_by(v, F.col(ts)) - F.min(v),
            "steps": F.count(F.lit(1))}
        aggs += [m.alias(k if isinstance(value, str) else f"{name}_{k}") for k, m in measures.items()]
    return r.groupBy(sym).agg(*aggs, *also)


def backtest_steps(ledger: DataFrame, *, sym: str = SYM, ts: str = TS, **kw) -> DataFrame:
    """``ledger`` with the step's number from 1 and the rewards added up so far."""
    def build(df, carries):
        carries["total_reward"] = ("_cr", "sum")
        return df.withColumn("_cr", K.local_cumsum(F.col("reward"), sym))

    out = run_series(ledger, build, halo=0, sym=sym, ts=ts, keep_layout=True, **kw)
    return out.withColumn("step", F.col(RN).cast("long")).drop(*LAYOUT_COLS)


def backtest_report(ledger: DataFrame, *, chunk: int = REPORT_STEPS, sym: str = SYM, ts: str = TS,
                    largest: int | None = None, total: int = 0, **kw) -> tuple[DataFrame, DataFrame]:
    """The report of a replay: one row a symbol, and its steps.

    The first frame has steps, total reward, last balance and equity, MFE, MAE and
    the drawdown ratio of the step prices, Sharpe and Sortino of the rewards
    added up (a return on a sum of 0 is null). The second has the step arrays:
    one row for each ``chunk`` steps of a symbol (part 0, 1, ...), so that no row grows
    with the series. An empty ledger gives two empty frames.

    ``largest`` and ``total`` are the rows of the longest series and of all, where known
    (a replay has those of its actions); else the ledger is written before it is counted.
    If every series is one part, rows are dealt out once and only the report is written,
    not its steps.
    """
    ledger = ledger.select(sym, ts, "balance", "equity", "reward", "step_price")
    if largest is None:
        ledger = stored(ledger, "backtest-ledger")
        largest, total = series_sizes(ledger, sym)
    sized = {"largest": largest, "total": total, **kw}
    steps = backtest_steps(ledger, sym=sym, ts=ts, **sized)
    last = F.max_by(F.struct("total_reward", "balance", "equity"), "step").alias("l")
    listed = F.array_sort(F.collect_list(F.struct("step", "total_reward", "step_price")))
    arrays = [F.col("s.total_reward").alias("step_rewards"), F.col("s.step_price").alias("step_prices")]
    values = ["step_price", "total_reward"]
    if largest <= min(chunk, kw.get("block_rows", DEFAULT_BLOCK_ROWS)):
        # the rows are dealt by symbol already: no number of partitions is asked for again
        whole = performance(steps, values, sym=sym, ts=ts, also=[last, listed.alias("s")], **{**sized, "total": 0})
        whole = stored(whole.select("*", *arrays).drop("s"), "backtest-report", let_go=True)
        rows = whole.select(sym, F.lit(0).cast("long").alias("part"), "step_rewards", "step_prices")
    else:
        steps = stored(steps, "backtest-steps", let_go=True)
        whole = performance(steps, values, sym=sym, ts=ts, also=[last], **sized)
        part = F.floor((F.col("step") - 1) / F.lit(chunk)).cast("long")
        rows = steps.groupBy(sym, part.alias("part")).agg(listed.alias("s")).select(sym, "part", *arrays)
    summary = whole.select(
        sym, F.col("step_price_steps").alias("steps"), F.col("l.total_reward").alias("total_reward"),
        F.col("l.balance").alias("final_balance"), F.col("l.equity").alias("final_equity"),
        F.col("step_price_mfe").alias("mfe"), F.col("step_price_mae").alias("mae"),
        F.col("total_reward_sharpe_ratio").alias("sharpe_ratio"), F.col("total_reward_sortino_ratio").alias("sortino_ratio"),
        F.col("step_price_max_drawdown").alias("max_drawdown"))
    return summary, rows


def risk_status(series: DataFrame, value: str = "close", *, sym: str = SYM, ts: str = TS,
                max_drawdown: float = 0.2, stop_loss: float = 0.05, take_profit: float = 0.1,
                **kw) -> DataFrame:
    """Running high/low-water marks against the first value; limits lie in
    (0, 1). Status, the first that holds: drawdown > limit -> STOP_TRADING, >= stop -> STOP_LOSS,
    profit >= take -> TAKE_PROFIT, else CONTINUE_TRADING."""
    for name, limit in (("max_drawdown", max_drawdown), ("stop_loss", stop_loss), ("take_profit", take_profit)):
        if not 0 < limit < 1:
            raise ValueError(f"{name} lies between 0 and 1, got {limit!r}")
    series = stored(series, "risk-series")  # read four times below; a replay is behind it
    first = series.groupBy(sym).agg(F.min_by(F.col(value), F.col(ts)).alias("initial"))

    def build(df, carries):
        df = df.withColumns({"_hi": K.local_cummax(value, sym), "_lo": K.local_cummin(value, sym)})
        carries.update({"high_water": ("_hi", "max"), "low_water": ("_lo", "min")})
        return df

    r = run_series(series, build, halo=0, sym=sym, ts=ts, **kw)
    from ..plans.layout import key_count, maybe_broadcast
    r = r.join(maybe_broadcast(first, key_count(series, sym)), sym)
    dd = F.try_divide(F.col("high_water") - F.col(value), F.col("high_water"))
    profit = F.try_divide(F.col(value) - F.col("initial"), F.col("initial"))
    status = (F.when(dd > max_drawdown, "STOP_TRADING").when(dd >= stop_loss, "STOP_LOSS")
              .when(profit >= take_profit, "TAKE_PROFIT").otherwise("CONTINUE_TRADING"))
    return r.withColumns({"drawdown": dd, "profit": profit, "status": status})


def risk_truncate(status: DataFrame, *, sym: str = SYM, ts: str = TS, fee: float = FEE) -> DataFrame:
    """Keep each symbol's rows up to and including its first non-CONTINUE row.

    Where the rows hold an account (balance, shares, equity; see ``action_ledger``), an
    episode that ends by STOP_LOSS or TAKE_PROFIT sells all its shares at the price they
    are valued at: balance and equity are then the cash after the fee, shares 0. An
    account stopped by STOP_TRADING keeps its position."""
    from ..plans.layout import key_count, maybe_broadcast
    status = stored(status, "risk-status")
    stop = (status.where(F.col("status") != "CONTINUE_TRADING").groupBy(sym)
            .agg(F.min(ts).alias("_stop")))
    out = status.join(maybe_broadcast(stop, key_count(status, sym)), sym, "left")
    out = out.where(F.col("_stop").isNull() | (F.col(ts) <= F.col("_stop")))
    if {"balance", "shares", "equity"} <= set(status.columns):
        sells = (F.col(ts) == F.col("_stop")) & F.col("status").isin("STOP_LOSS", "TAKE_PROFIT")
        cash = F.col("balance") + (F.col("equity") - F.col("balance")) * (1 - fee)
        out = out.withColumns({"balance": F.when(sells, cash).otherwise(F.col("balance")),
                               "shares": F.when(sells, 0.0).otherwise(F.col("shares")),
                               "equity": F.when(sells, cash).otherwise(F.col("equity"))})
    return out.drop("_stop")


def _clip(x, lo, hi):
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def risk_parameters(conditions: DataFrame, vol: str = "volatility", trend: str = "trend", *,
                    max_drawdown: float = 0.2, stop_loss: float = 0.05, take_profit: float = 0.1) -> DataFrame:
    """Limits from market conditions (missing vol/trend = 0.1) around base limits, which lie in (0, 1)."""
    for name, limit in (("max_drawdown", max_drawdown), ("stop_loss", stop_loss), ("take_profit", take_profit)):
        if not 0 < limit < 1:
            raise ValueError(f"{name} lies between 0 and 1, got {limit!r}")
    v = F.coalesce(F.col(vol), F.lit(0.1))
    t = F.coalesce(F.col(trend), F.lit(0.1))
    return conditions.withColumns({"max_drawdown": _clip(max_drawdown * v, 0.1, 0.3),
                                   "stop_loss": _clip(stop_loss * t, 0.02, 0.1),
                                   "take_profit": _clip(take_profit * t, 0.05, 0.2)})


def option_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Option orders (state, price, cumulative_quantity as numeric strings,
    created_at, legs array) derived from orders x lineitem: one leg per line
    item; the legs array is bounded by the lines of one order."""
    legs = (lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_partkey").cast("string").alias("option_id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("string").alias("price"),
        F.col("l_quantity").cast("string").alias("executed_quantity"))).alias("legs"),
        F.sum("l_quantity").cast("string").alias("cumulative_quantity")))
    o = orders.select(F.col("o_orderkey").alias("order_id"),
                      F.when(F.col("o_orderstatus") == "F", "filled")
                      .when(F.col("o_orderstatus") == "O", "queued").otherwise("cancelled")
                      .alias("state"),
                      (F.col("o_totalprice") / 10000).cast("string").alias("price"),
                      F.col("o_orderdate").alias("created_at"))
    return o.join(legs, o.order_id == legs.l_orderkey).drop("l_orderkey")


def option_contract_pnl(opt: DataFrame) -> DataFrame:
    """Filled orders; one row per contract: a leg executed q times yields q
    copies (q = 0 yields none); P/L = order price - leg price."""
    legs = (opt.where(F.col("state") == "filled")
            .select("order_id", F.col("price").cast("double").alias("order_price"),
                    F.explode("legs").alias("leg")))
    q = F.floor(F.col("leg.executed_quantity").cast("double")).cast("int")
    copies = legs.withColumn("copy", F.explode(F.when(q > 0, F.sequence(F.lit(1), q))
                                               .otherwise(F.array().cast("array<int>"))))
    return copies.select("order_id", F.col("leg.option_id").alias("option_id"), "copy",
                         (F.col("order_price") - F.col("leg.price").cast("double")).alias("pnl"))


def option_trade_pnl(opt: DataFrame) -> DataFrame:
    """Per leg: cumulative_quantity * (order price - leg price)."""
    legs = (opt.where(F.col("state") == "filled")
            .select("order_id", F.col("price").cast("double").alias("order_price"),
                    F.col("cumulative_quantity").cast("double").alias("qty"),
                    F.explode("legs").alias("leg")))
    return legs.select("order_id", F.col("leg.option_id").alias("option_id"),
                       (F.col("qty") * (F.col("order_price") - F.col("leg.price").cast("double")))
                       .alias("pnl"))


def trade_summary(pnl: DataFrame, col: str = "pnl") -> DataFrame:
    """wins (> 0), losses (<= 0), accuracy %, averages and totals; 0 trades -> 0."""
    p = F.col(col)
    n = F.count(p)
    wins = F.count(F.when(p > 0, 1))
    return pnl.agg(
        wins.alias("wins"), F.count(F.when(p <= 0, 1)).alias("losses"),
        F.coalesce(F.try_divide(wins * 100.0, n), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("average_profit"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("average_loss"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("total_profit"),
        F.coalesce(F.sum(F.when(p <= 0, p)), F.lit(0.0)).alias("total_loss"))
