"""Which filter removes what, in every order of the filters.

Filters only look at the document, so what a filter removes depends on the set
of filters before it, not on their order: 2**k sets (states) stand for k! orders.
A forward count says how many orders reach a state, a backward count how many
go on from it; their product along an edge (state, next filter) is the number
of orders that take the edge. Edge removals weighted with it add up to the
Shapley sum of a filter, and each step of each order reads its figures from
the edge it takes.

Documents are reduced to one bit mask of failed filters; counts per (part, mask)
are a partial aggregate, at most 2**k rows a part, and all else runs on those.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SEPARATOR, staged

#: The filters of ``document_filters``; a filter's place is its bit.
FILTERS = "ABCDE"
#: k! * k rows of steps are broadcast: 4,320 at most.
MOST_FILTERS = 6


def paths(k: int) -> tuple[list[int], list[int]]:
    """(orders reaching each state, orders leaving it for the full set), by counting along edges."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for i in range(k):
            if not state >> i & 1:
                forward[state | 1 << i] += forward[state]
    for state in range(full, -1, -1):
        for i in range(k):
            if not state >> i & 1:
                backward[state] += backward[state | 1 << i]
    return forward, backward


def edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that take this edge) of the lattice: k * 2**(k - 1) rows."""
    forward, backward = paths(k)
    return [(s, i, forward[s] * backward[s | 1 << i]) for s in range(1 << k) for i in range(k) if not s >> i & 1]


def document_filters(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Rows (part, mask, good, toxic) of all documents; bits of ``mask`` are failed filters A to E.

    A: under 50 words. B: under 65 % distinct words. C: over 5 % capital
    letters. D: a character of ``#$%&*|``. E: equal to the text of a row with
    a smaller key. Null text is empty, a null part the empty string; a row with
    a null key has no smaller one and no label; repeated rows count each, and
    rows with the smallest key of a text are all first. ``good`` and ``toxic``
    are 1 if any label row of the key says so.

    The first of a text is a partial minimum by digest. Rows look themselves
    up by (digest, key), which no group of copies makes hot.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(body, WORD_SEPARATOR), "")
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                    body.alias("body"), words.alias("words"))
    n = F.size("words")
    bits = [n < 50,
            100 * F.size(F.array_distinct("words")).cast("long") < 65 * n.cast("long"),
            100 * F.length(F.regexp_replace("body", "[^A-Z]+", "")).cast("long") > 5 * F.length("body").cast("long"),
            F.col("body").rlike(r"[#$%&*|]")]
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    d = staged(d.select("key", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest")), "filters")
    first = d.where("key is not null").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    later = F.col("key").isNotNull() & F.col("first").isNull()
    d = d.join(first, ["digest", "key"], "left").join(said, "key", "left")
    return d.select("part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from rows (part, mask, good, toxic).

    ``filters`` names the bits of ``mask``, lowest first. An empty table gives
    an empty result; every part has all orders, with zeros.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set(filters)) != k:
        raise ValueError(f"one to {MOST_FILTERS} filters with names of their own, not {filters!r}")
    spark = masks.sparkSession
    cells = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    lattice = edges(k)
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << i).alias("bit"), F.lit(w).alias("orders"))
                               for s, i, w in lattice]))
    at = cells.withColumn("edge", edge).select("part", "mask", "n", "good", "toxic", "edge.*")
    mask, state, bit = F.col("mask"), F.col("state"), F.col("bit")
    fails = mask.bitwiseAND(bit) != 0
    falls = fails & (mask.bitwiseAND(state) == 0)

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    at = at.groupBy("part", "state", "bit", "orders").agg(
        total(mask.bitwiseAND(state.bitwiseOR(bit)) == 0).alias("kept"),
        total(falls).alias("removed"),
        (total(fails) - total(falls)).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(falls, "good").alias("good_lost"),
        total(falls, "toxic").alias("toxic_lost"))
    whole = Window.partitionBy("part", "bit")  # 2**(k - 1) edges
    at = at.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(whole).cast("long"))
    steps = []
    for order in itertools.permutations(range(k)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, state, 1 << i))
            state |= 1 << i
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, bit int"))
    return at.join(steps, ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
