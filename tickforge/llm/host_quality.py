"""Quality rules for documents, with verdicts on their hosts.

Every document is measured by built-in functions only. A host's failures are
shrunk towards a beta prior fitted to all hosts (method of moments), so a host
with three documents is not judged by three documents. Rows of a host whose
shrunken rate is over ``HOST_LIMIT`` must also satisfy the soft rules; a
document that breaks no rule is kept on any host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATOR, fresh, staged

WINDOW = 5
HOST_LIMIT = 0.5
#: Prior strength (alpha + beta) is held between these; the first also serves where hosts do not differ.
STRENGTH = (2.0, 1000.0)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _repeated(hashes: Column, n: Column) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes.

    A hash shifted left with its position in the low bits sorts as a plain
    long; neighbours with one full hash are repeats. Their positions, sorted
    again, give the covered words: each window adds what the one before it
    has not covered.
    """
    bits = F.length(F.bin(n))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.sort_array(F.transform(
        hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))

    def places(sorted_: Column) -> Column:
        def at(x):
            return F.get(hashes, x.bitwiseAND(mask).cast("int"))
        twice = F.filter(sorted_, lambda x, j: F.coalesce(at(x) == at(F.get(sorted_, j - 1)), F.lit(False))
                         | F.coalesce(at(x) == at(F.get(sorted_, j + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    return F.aggregate(
        F.get(F.transform(F.array(packed), places), F.lit(0)),
        F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``measures`` (a fresh name if taken: the last column).

    Null text has no words. Windows are compared by 64-bit hashes within one
    text, so the work of a text is its length times a logarithm.
    """
    words, lines, hashes, out = fresh(docs, "_words", "_lines", "_hashes", "measures")
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get(F.col(words), i + k) for k in range(WINDOW)]))
    d = (docs
         .withColumn(words, F.array_remove(F.split(body, WORD_SEPARATOR), ""))
         .withColumn(lines, F.split(body, "\n"))
         .withColumn(hashes, F.when(n > WINDOW, windows)))
    real = F.filter(F.col(lines), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    distinct = F.size(F.array_distinct(F.col(hashes)))
    return d.select(*docs.columns, F.struct(
        long(n).alias("n_words"),
        long(F.length(F.array_join(F.col(words), ""))).alias("word_chars"),
        long(F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size(real) - F.size(F.array_distinct(real))).alias("n_dup_lines"),
        F.when(F.col(hashes).isNull() | (distinct == F.size(hashes)), F.lit(0).cast("long"))
        .otherwise(_repeated(F.col(hashes), n)).alias("n_repeat_words"),
        long(F.size(real)).alias("n_lines")).alias(out))


def failures(m: Column) -> tuple[Column, Column]:
    """(base rules failed, soft rules failed) of a ``measures`` column, in whole numbers."""
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    soft = ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])
            | (10 * m["n_symbols"] > 3 * m["n_words"])
            | (10 * m["n_dup_lines"] > 3 * m["n_lines"]))
    return base, soft


def judge(docs: DataFrame, host: str = "source", text: str = "text",
          carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns measures, base_failed, host_rejected and kept.

    ``carry`` names the columns of ``docs`` to go along (all unless given).
    Returns the frame and the four names, which are fresh where ``docs`` has
    such columns. A null host is a host of its own. The measured rows are
    written once to the shared folder, with the carried columns; hosts are
    a partial aggregate over them, and the join back to the documents is an
    ordinary equi-join (broadcast below Spark's size threshold, else sorted
    with skewed hosts split). An empty table gives an empty result.
    """
    m, b, s, r, k, h = fresh(docs, "measures", "base_failed", "_soft", "host_rejected", "kept", "_host")
    d = measure(docs, text)
    d = d.withColumnRenamed(d.columns[-1], m)
    base, soft = failures(F.col(m))
    own = docs.columns if carry is None else carry
    d = d.withColumn(b, base).withColumn(s, soft).withColumn(h, F.col(host))
    d = staged(d.select(*own, h, m, b, s), "quality")
    rates = d.groupBy(h).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col(b) | F.col(s)).cast("long")).alias("_bad"))
    rates = staged(rates, "quality-hosts")
    rate = F.col("_bad") / F.col("_n")
    mean, var = rates.agg(F.avg(rate), F.var_samp(rate)).first()
    alpha, beta = beta_prior(mean, var)
    verdicts = rates.select(h, (
        F.col("_bad") + alpha > HOST_LIMIT * (F.col("_n") + alpha + beta)).alias(r))
    out = d.join(verdicts, d[h].eqNullSafe(verdicts[h]), "left").drop(h)
    out = out.withColumn(k, ~F.col(b) & ~(F.col(r) & F.col(s)))
    return out.select(*own, m, b, r, k), [m, b, r, k]


def beta_prior(mean: float | None, var: float | None) -> tuple[float, float]:
    """Alpha and beta by moments of the hosts' rates; a weak prior where they say nothing."""
    if mean is None:
        return STRENGTH[0] / 2, STRENGTH[0] / 2
    spread = mean * (1 - mean)
    strength = spread / var - 1 if var and 0 < spread else STRENGTH[0]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    return mean * strength, (1 - mean) * strength


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    judged, (_, _, _, kept) = judge(docs, host, text)
    return judged.where(F.col(kept)).select(*docs.columns)
