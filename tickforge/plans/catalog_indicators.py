"""Registered indicator queries (Spark) and their DuckDB oracles.

Every query reads the whole driver table, derives bars, runs one indicator
for all symbols and rounds doubles (``floor(x*10^d+0.5)/10^d``, identical in
both engines). Recursive indicators (EMA/Wilder chains, PSAR) round to 4
digits: the doubling kernel and the SQL recursion add terms in a different
order, and 4 digits keeps the last-bit noise far from a rounding edge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.indicators import output_columns, with_indicators
from ..sources.tables import EVENT_BARS_SQL, event_bars, line_bars
from .sqlkit import HALF, P, cum, full, numbered, rnd, rows, tdiv

REC_DIGITS = 4
BARS_EVENT = EVENT_BARS_SQL


def spark_round(col, digits=6):
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(10.0 ** digits) + F.lit(float(HALF))) / F.lit(10.0 ** digits)


def indicator_query(name, params=None, bars="line", digits=6):
    def run(spark, sf_dir):
        b = line_bars(spark, sf_dir) if bars == "line" else event_bars(spark, sf_dir)
        p = {name: params} if params else None
        out = with_indicators(b, [name], params=p)
        cols = output_columns(name, params)
        return out.select("symbol", "ts", *[spark_round(c, digits).alias(c) for c in cols])
    return run


def _recursive(name, base, init: dict, step: dict, start_rn: str | int = 1):
    """Recursive CTE over (symbol, rn): ``init`` at rn = start, then ``step``
    with ``b.`` = current row of ``base`` and ``p.`` = previous state."""
    cols = ", ".join(init)
    first = ", ".join(f"{e} AS {c}" for c, e in init.items())
    nxt = ", ".join(f"{step[c]} AS {c}" for c in init)
    start = f"rn = {start_rn}" if isinstance(start_rn, int) else start_rn
    return (f"{name}(symbol, rn, {cols}) AS (\n"
            f"  SELECT symbol, rn, {first} FROM {base} WHERE {start}\n"
            f"  UNION ALL\n"
            f"  SELECT b.symbol, b.rn, {nxt} FROM {name} p JOIN {base} b\n"
            f"    ON b.symbol = p.symbol AND b.rn = p.rn + 1)")


def _a(span):
    return 2.0 / (span + 1.0)


def _select(cols_exprs, src="s", digits=6, tail=""):
    sel = ", ".join(f"{rnd(e, digits)} AS {c}" for c, e in cols_exprs)
    return f"SELECT symbol, ts, {sel} FROM {src} {tail}"


def sql_stochastic(n=14):
    return (numbered() + f""",
a AS (SELECT symbol, ts, close, min(low) {rows(n)} AS ll, max(high) {rows(n)} AS hh FROM s),
b AS (SELECT symbol, ts, 100.0 * (close - ll) / (CASE WHEN hh - ll = 0 THEN 1.0 ELSE hh - ll END)
      AS st FROM a)
""" + _select([("Stochastic", "st"), ("Stochastic_Signal", f"avg(st) {rows(3)}")], "b"))


def sql_rsi(n=14, kind="default"):
    isfull = kind != "default"
    ag = full("avg", "gain", n) if isfull else f"avg(gain) {rows(n)}"
    al = full("avg", "loss", n) if isfull else f"avg(loss) {rows(n)}"
    val = "CASE WHEN al = 0 THEN (CASE WHEN ag > 0 THEN 100.0 END) " \
          "ELSE 100.0 - 100.0 / (1.0 + ag / al) END"
    if kind != "strict":
        val = f"coalesce({val}, 0.0)"
    return (numbered() + f""",
a AS (SELECT symbol, ts, close - lag(close) OVER ({P}) AS d FROM s),
g AS (SELECT symbol, ts, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain,
             CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM a),
m AS (SELECT symbol, ts, {ag} AS ag, {al} AS al FROM g)
""" + _select([("RSI", val)], "m"))


def sql_williams(n=14):
    return (numbered() + f""",
a AS (SELECT symbol, ts, close, min(low) {rows(n)} AS ll, max(high) {rows(n)} AS hh FROM s)
""" + _select([("Williams_R", "coalesce(-100.0 * (hh - close) / "
                              "(CASE WHEN hh - ll = 0 THEN 1.0 ELSE hh - ll END), 0.0)")], "a"))


def sql_roc(n=10):
    return (numbered() + f""",
a AS (SELECT symbol, ts, close, lag(close, {n}) OVER ({P}) AS p FROM s)
""" + _select([("ROC", f"CASE WHEN p IS NULL THEN 0.0 ELSE 100.0 * {tdiv('close - p', 'p')} END")],
              "a"))


def sql_trix(span=15, sig=9):
    a, r = _a(span), 1 - _a(span)
    a9, r9 = _a(sig), 1 - _a(sig)
    e1 = f"({a} * b.close + {r} * p.e1)"
    e2 = f"({a} * {e1} + {r} * p.e2)"
    e3 = f"({a} * {e2} + {r} * p.e3)"
    trix = f"(100.0 * ({tdiv(e3, 'p.e3')} - 1.0))"
    rec = _recursive("t", "s", {"e1": "close", "e2": "close", "e3": "close",
                                "trix": "CAST(NULL AS DOUBLE)", "sig": "CAST(NULL AS DOUBLE)"},
                     {"e1": e1, "e2": e2, "e3": e3, "trix": trix,
                      "sig": f"(CASE WHEN p.rn = 1 THEN {trix} ELSE {a9} * {trix} + {r9} * p.sig END)"})
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + rec + "\n" +
            _select([("TRIX", "t.trix"), ("TRIX_signal", "t.sig")],
                    "t JOIN s USING (symbol, rn)", REC_DIGITS))


def sql_sma(n=10):
    return numbered() + "\n" + _select([(f"SMA_{n}", full("avg", "close", n))])


def sql_ema(n=10):
    a, r = _a(n), 1 - _a(n)
    rec = _recursive("e", "s", {"v": "close"}, {"v": f"{a} * b.close + {r} * p.v"})
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + rec + "\n" +
            _select([(f"EMA_{n}", "e.v")], "e JOIN s USING (symbol, rn)", REC_DIGITS))


def sql_macd(fast=12, slow=26, sig=9):
    af, rf, asl, rsl, a9, r9 = _a(fast), 1 - _a(fast), _a(slow), 1 - _a(slow), _a(sig), 1 - _a(sig)
    f = f"({af} * b.close + {rf} * p.f)"
    sl = f"({asl} * b.close + {rsl} * p.sl)"
    m = f"({f} - {sl})"
    sg = f"({a9} * {m} + {r9} * p.sg)"
    h = f"({m} - {sg})"
    hs = f"({a9} * {h} + {r9} * p.hs)"
    rec = _recursive("e", "s", {"f": "close", "sl": "close", "sg": "CAST(0.0 AS DOUBLE)", "hs": "CAST(0.0 AS DOUBLE)"},
                     {"f": f, "sl": sl, "sg": sg, "hs": hs})
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + rec + "\n" +
            _select([("MACD", "e.f - e.sl"), ("MACD_Signal", "e.sg"),
                     ("MACD_Hist", "e.f - e.sl - e.sg"), ("MACD_Hist_Signal", "e.hs")],
                    "e JOIN s USING (symbol, rn)", REC_DIGITS))


def sql_adx(n=14):
    k = (n - 1.0) / n
    return ("WITH RECURSIVE " + numbered()[5:] + f""",
d AS MATERIALIZED (SELECT symbol, rn, ts,
    CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN rn > 1 THEN (CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END) END AS pdm,
    CASE WHEN rn > 1 THEN (CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END) END AS mdm
  FROM (SELECT *, lag(close) OVER ({P}) AS pc, high - lag(high) OVER ({P}) AS up,
               lag(low) OVER ({P}) - low AS dn FROM s)),
ds AS MATERIALIZED (SELECT *, {full('sum', 'tr', n)} AS s_tr, {full('sum', 'pdm', n)} AS s_p,
               {full('sum', 'mdm', n)} AS s_m FROM d),
{_recursive('w', 'ds', {'wt': 's_tr', 'wp': 's_p', 'wm': 's_m'},
            {'wt': f'b.tr + {k} * p.wt', 'wp': f'b.pdm + {k} * p.wp', 'wm': f'b.mdm + {k} * p.wm'},
            n + 1)},
dx AS MATERIALIZED (SELECT symbol, rn, coalesce(100.0 * {tdiv('abs(pdi - mdi)', 'pdi + mdi')}, 0.0) AS dx
  FROM (SELECT symbol, rn, 100.0 * {tdiv('wp', 'wt')} AS pdi, 100.0 * {tdiv('wm', 'wt')} AS mdi
        FROM w)),
dxs AS MATERIALIZED (SELECT *, {full('avg', 'dx', n, 'PARTITION BY symbol ORDER BY rn')} AS seed FROM dx),
{_recursive('ax', 'dxs', {'adx': 'seed'}, {'adx': f'b.dx / {n} + {k} * p.adx'}, 2 * n)}
""" + _select([("ADX", "ax.adx")], "s LEFT JOIN ax USING (symbol, rn)", REC_DIGITS))


def sql_ichimoku(n1=9, n2=26, n3=52):
    def line(n):
        return f"(({full('max', 'high', n)} + {full('min', 'low', n)}) / 2)"
    return (numbered() + f""",
a AS (SELECT symbol, ts, close, {line(n1)} AS conv, {line(n2)} AS base, {line(n3)} AS spb FROM s)
""" + _select([("Ichimoku_Conversion_Line", "conv"), ("Ichimoku_Base_Line", "base"),
               ("Ichimoku_Leading_Span_A", f"lag((conv + base) / 2, {n2}) OVER ({P})"),
               ("Ichimoku_Leading_Span_B", f"lag(spb, {n2}) OVER ({P})"),
               ("Ichimoku_Lagging_Span", f"lead(close, {n2}) OVER ({P})")], "a"))


def sql_psar(step=0.02, max_step=0.2):
    # state: psar, extreme high, extreme low, bullish, af; one CTE step per bar
    raw = "(CASE WHEN p.bull THEN p.ps + p.af * (p.eh - p.ps) ELSE p.ps + p.af * (p.el - p.ps) END)"
    flip = f"(CASE WHEN p.bull THEN b.low < {raw} ELSE b.high > {raw} END)"
    bull = f"(p.bull <> {flip})"
    eh = "(CASE WHEN p.bull THEN greatest(p.eh, b.high) ELSE p.eh END)"
    el = "(CASE WHEN p.bull THEN p.el ELSE least(p.el, b.low) END)"
    ps0 = f"(CASE WHEN {flip} THEN (CASE WHEN p.bull THEN p.eh ELSE p.el END) ELSE {raw} END)"
    ps = f"(CASE WHEN {bull} THEN least({ps0}, p.pl) ELSE greatest({ps0}, p.ph) END)"
    af0 = f"(CASE WHEN {flip} THEN {step} ELSE p.af END)"
    grow = f"(({bull} AND b.high > {eh}) OR (NOT {bull} AND b.low < {el}))"
    af = f"(CASE WHEN {grow} THEN least({af0} + {step}, {max_step}) ELSE {af0} END)"
    rec = _recursive("r", "s", {"ps": "close", "eh": "high", "el": "low", "bull": "true",
                                "af": f"CAST({step} AS DOUBLE)", "ph": "high", "pl": "low"},
                     {"ps": ps, "eh": eh, "el": el, "bull": bull, "af": af, "ph": "b.high",
                      "pl": "b.low"})
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + rec + "\n" +
            _select([("PSAR", "r.ps")], "r JOIN s USING (symbol, rn)", REC_DIGITS))


def sql_bollinger(n=10, k=2):
    return (numbered() + f""",
a AS (SELECT symbol, ts, avg(close) {rows(n)} AS m, coalesce(stddev_samp(close) {rows(n)}, 0.0) AS sd
      FROM s)
""" + _select([("Bollinger_High", f"m + sd * {k}"), ("Bollinger_Low", f"m - sd * {k}"),
               ("Bollinger_Mid", "m")], "a"))


def sql_rolling_std(n=20):
    return numbered() + "\n" + _select(
        [("Standard_Deviation", f"coalesce(stddev_samp(close) {rows(n)}, 0.0)")])


def sql_hv(n=20):
    ratio = tdiv("close", f"lag(close) OVER ({P})")
    return (numbered() + f""",
a AS (SELECT symbol, ts, coalesce(CASE WHEN {ratio} > 0 THEN ln({ratio}) END, 0.0) AS lr FROM s)
""" + _select([("Historical_Volatility", f"stddev_samp(lr) {rows(n)} * sqrt({n})")], "a"))


def _atr_ctes(n, name="atrw"):
    return f"""tr AS MATERIALIZED (SELECT *, CASE WHEN rn > 1 THEN greatest(high - low,
      abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER ({P}) AS pc FROM s)),
trs AS MATERIALIZED (SELECT *, {full('avg', 'tr', n)} AS seed FROM tr),
{_recursive(name, 'trs', {'atr': 'seed'}, {'atr': f'b.tr / {n} + {(n - 1.0) / n} * p.atr'}, n + 1)},
j AS (SELECT trs.*, coalesce({name}.atr, 0.0) AS atr FROM trs LEFT JOIN {name} USING (symbol, rn))"""


def sql_atr(n=14):
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + _atr_ctes(n) + "\n" +
            _select([("ATR", "atr")], "j", REC_DIGITS))


def sql_chandelier(n=22, m=3):
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + _atr_ctes(n) + "\n" +
            _select([("Chandelier_Exit_Long", f"max(high) {rows(n)} - {m} * atr")], "j",
                    REC_DIGITS))


def sql_keltner(n=20, m=2):
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + _atr_ctes(n) + f""",
k AS (SELECT symbol, ts, atr, avg(close) {rows(n)} AS mid FROM j)
""" + _select([("Keltner_Channel_High", f"mid + {m} * atr"), ("Keltner_Channel_Low", f"mid - {m} * atr"),
               ("Keltner_Channel_Mid", "mid")], "k", REC_DIGITS))


def sql_envelope(n=10, pct=0.025):
    return (numbered() + f""",
a AS (SELECT symbol, ts, avg(close) {rows(n)} AS m FROM s)
""" + _select([("MAE_Upper", f"m * {1 + pct}"), ("MAE_Lower", f"m * {1 - pct}")], "a"))


def sql_mfi(n=14):
    return (numbered() + f""",
a AS (SELECT symbol, ts, (high + low + close) / 3 * volume AS flow, close,
             lag(close) OVER ({P}) AS pc FROM s),
b AS (SELECT symbol, ts, sum(CASE WHEN close > pc THEN flow ELSE 0.0 END) {rows(n)} AS pos,
             sum(CASE WHEN close < pc THEN flow ELSE 0.0 END) {rows(n)} AS neg FROM a)
""" + _select([("MFI", "coalesce(100.0 - 100.0 / (1.0 + pos / "
                       "(CASE WHEN neg = 0 THEN 1.0 ELSE neg END)), 0.0)")], "b"))


def sql_obv():
    return (numbered() + f""",
a AS (SELECT symbol, ts, CAST(volume AS DOUBLE) *
             coalesce(CAST(sign(close - lag(close) OVER ({P})) AS DOUBLE), 0.0) AS st FROM s)
""" + _select([("OBV", f"sum(st) {cum()}")], "a"))


def sql_vwap(price_type="typical"):
    px = "(high + low + close) / 3" if price_type == "typical" else "(high + low + 2 * close) / 4"
    return (numbered() + f""",
a AS (SELECT symbol, ts, {px} * CAST(volume AS DOUBLE) AS pv, CAST(volume AS DOUBLE) AS v FROM s)
""" + _select([("VWAP", tdiv(f"sum(pv) {cum()}", f"sum(v) {cum()}"))], "a"))


def sql_adl():
    num = "((close - low) - (high - close))"
    return (numbered() + f""",
a AS (SELECT *, last_value(CASE WHEN high - low <> 0 THEN high - low END IGNORE NULLS) {cum()} AS rng
      FROM s),
b AS (SELECT symbol, ts, CASE WHEN {num} = 0 THEN 0.0 ELSE coalesce({tdiv(num, 'rng')}, 0.0) END
      * volume AS m FROM a)
""" + _select([("ADL", f"sum(m) {cum()}")], "b"))


def sql_cmf(n=14):
    num = "((close - low) - (high - close))"
    return (numbered() + f""",
a AS (SELECT symbol, ts, coalesce({tdiv(num, 'high - low')}, 0.0) * volume AS mfv,
             CAST(volume AS DOUBLE) AS v FROM s)
""" + _select([("CMF", tdiv(f"sum(mfv) {rows(n)}", f"sum(v) {rows(n)}"))], "a"))


def sql_volume_osc(short=12, long=26):
    a1, r1, a2, r2 = _a(short), 1 - _a(short), _a(long), 1 - _a(long)
    rec = _recursive("e", "s", {"vs": "CAST(volume AS DOUBLE)", "vl": "CAST(volume AS DOUBLE)"},
                     {"vs": f"{a1} * b.volume + {r1} * p.vs", "vl": f"{a2} * b.volume + {r2} * p.vl"})
    return ("WITH RECURSIVE " + numbered()[5:] + ",\n" + rec + "\n" +
            _select([("Volume_Oscillator", "e.vs - e.vl")], "e JOIN s USING (symbol, rn)",
                    REC_DIGITS))


def sql_sample_custom(n=10):
    return numbered() + "\n" + _select([("Sample_Custom_Indicator", full("avg", "close", n))])


def sql_another_custom(n=5):
    return numbered() + "\n" + _select([("Another_Custom_Indicator",
                                         full("stddev_samp", "close", n))])


def catalog():
    """name -> (spark query, oracle sql)."""
    R = REC_DIGITS
    return {
        "stochastic_oscillator": (indicator_query("stochastic_oscillator"), sql_stochastic()),
        "rsi": (indicator_query("rsi"), sql_rsi()),
        "rsi_custom": (indicator_query("rsi_custom"), sql_rsi(kind="custom")),
        "rsi_strict": (indicator_query("rsi_strict"), sql_rsi(kind="strict")),
        "williams_r": (indicator_query("williams_r"), sql_williams()),
        "roc": (indicator_query("roc"), sql_roc()),
        "trix": (indicator_query("trix", digits=R), sql_trix()),
        "sma": (indicator_query("sma"), sql_sma()),
        "ema": (indicator_query("ema", digits=R), sql_ema()),
        "macd": (indicator_query("macd", digits=R), sql_macd()),
        "adx": (indicator_query("adx", digits=R), sql_adx()),
        "ichimoku": (indicator_query("ichimoku"), sql_ichimoku()),
        "psar": (indicator_query("psar", digits=R), sql_psar()),
        "bollinger": (indicator_query("bollinger"), sql_bollinger()),
        "rolling_std": (indicator_query("rolling_std"), sql_rolling_std()),
        "historical_volatility": (indicator_query("historical_volatility"), sql_hv()),
        "atr": (indicator_query("atr", digits=R), sql_atr()),
        "chandelier_exit": (indicator_query("chandelier_exit", digits=R), sql_chandelier()),
        "keltner": (indicator_query("keltner", digits=R), sql_keltner()),
        "ma_envelope": (indicator_query("ma_envelope"), sql_envelope()),
        "mfi": (indicator_query("mfi"), sql_mfi()),
        "obv": (indicator_query("obv"), sql_obv()),
        "vwap": (indicator_query("vwap"), sql_vwap()),
        "adl": (indicator_query("adl"), sql_adl()),
        "cmf": (indicator_query("cmf"), sql_cmf()),
        "volume_oscillator": (indicator_query("volume_oscillator", digits=R), sql_volume_osc()),
        "sample_custom": (indicator_query("sample_custom"), sql_sample_custom()),
        "another_custom": (indicator_query("another_custom"), sql_another_custom()),
    }
