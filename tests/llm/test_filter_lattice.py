"""The filter audit against running every order on every document."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tickforge.llm import filter_lattice

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int, key string"


def fails(text):
    words = WORDS.findall(text)
    return {c for c, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                             ("C", 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text)),
                             ("D", bool(re.search(r"[#$%&*|]", text)))) if bad}


def brute(rows, labels):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    failed = []
    for i, t, _ in rows:
        f = fails(t)
        if i is not None and any(j is not None and j < i and u == t for j, u, _ in rows):
            f.add("E")
        failed.append(f)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, {}
    for part in {s for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if s == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                kept = [(i, f) for i, f in left if c not in f]
                redundant = sum(c in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = (
                    len(kept), len(gone), redundant, sum(f == {c} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " ", "# $", "ABC " * 60, "one two " * 40, " ".join(f"w{i}" for i in range(60)),
             " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}|" for i in range(70)), "x " * 20000, "日本 語" * 30]
    out = [(i, rng.choice(texts), rng.choice(["hot", "hot", "b", None, "", "c"])) for i in range(150)]
    return [*out, out[7], out[7], (None, "one two " * 40, "b"), (None, None, None), (3, "other text", "c")]


def test_audit_equals_every_order(spark, rows):
    labels = [(i, i % 3 % 2, i % 4 % 3) for i in range(0, 140, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    got = filter_lattice.audit(filter_lattice.document_filters(
        docs, spark.createDataFrame([(*x, "k") for x in labels], LABELS)))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert found == brute(rows, labels)
    assert len(found) == got.count() == 4 * 600  # the null part and the empty one are one
    assert dict(got.dtypes)["shapley"] == "bigint" and dict(got.dtypes)["step"] == "int"


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], LABELS)
    assert filter_lattice.audit(filter_lattice.document_filters(spark.createDataFrame([], DOCS), none)).count() == 0
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    lost = filter_lattice.audit(filter_lattice.document_filters(docs, none)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(lost) == (0, 0)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_path_counts(k):
    """Every order takes k edges; an edge's count is that of the orders that take it."""
    seen = {}
    for order in itertools.permutations(range(k)):
        state = 0
        for i in order:
            seen[state, i] = seen.get((state, i), 0) + 1
            state |= 1 << i
    assert {(s, i): w for s, i, w in filter_lattice.edges(k)} == seen


def test_names_of_filters(spark):
    masks = spark.createDataFrame([("p", 3, 1, 0), ("p", 1, 0, 0)], "part string, mask int, good int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_lattice.audit(masks, "xy").collect()}
    assert got == {("xy", 1): (0, 2, 0, 3), ("xy", 2): (0, 0, 1, 1), ("yx", 1): (1, 1, 0, 1), ("yx", 2): (0, 1, 1, 3)}
    for bad in ("", "aa", "abcdefg"):
        with pytest.raises(ValueError):
            filter_lattice.audit(masks, bad)
