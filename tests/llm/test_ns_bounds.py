"""Clustering with bounds against plain rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tickforge.llm import ns_bounds, queries

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance string"


def plain(rows, clusters, rounds, dims, seed=2):
    """(rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids)."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, c, d in at:
        per[c] = per.get(c, 0) + d
    return [(i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in at], cs


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    spots = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    out = [(i, f32([x + rng.gauss(0, 0.4) for x in rng.choice(spots)])) for i in range(600)]
    out += [(1000 + i, f32(out[5][1])) for i in range(40)]  # copies: equal first centroids and ties
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 7, [0.0] * 8, [-0.0] * 8, [nan] * 8, [1.0] * 7 + [None], [1.0] * 7 + [inf], [-inf] + [0.0] * 7,
           [1000.5, -2000.25, 1e5] + [0.0] * 5]
    out += [(2000 + i, v) for i, v in enumerate(odd)]
    return [*out, out[3], out[3], (None, out[9][1]), (None, None)]


@pytest.mark.parametrize("clusters,rounds", [(12, 5), (1, 2), (5, 0), (700, 2)])
def test_equals_plain_rounds(spark, rows, clusters, rounds):
    df = spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], VECTORS).repartition(4)
    found, history = ns_bounds.cluster(df, clusters=clusters, rounds=rounds, dimensions=8)
    want, cs = plain(rows, clusters, rounds, 8)
    assert history[-1].tolist() == cs and len(history) == rounds + 1
    got = ns_bounds.summary(found, history[-1]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op12_ns_bounds(spark, "/root/testdata/sf0.001")
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 40, 5, 64)[0])


def test_no_whole_vector(spark):
    for data in ([], [(1, None, 1, 1, "x")]):
        found, history = ns_bounds.cluster(spark.createDataFrame(data, VECTORS))
        assert found.count() == 0 and ns_bounds.summary(found, history[-1]).count() == 0


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        ns_bounds.cluster(spark.createDataFrame([(1, [6e5] + [0.0] * 63, 1, 1, "x")], VECTORS))


@pytest.mark.parametrize("scale", [3, 300, 1 << 26])
def test_bounds_hold_and_save_work(scale):
    """Stored distances, loosened by total displacement, never pass the true ones; few are computed anew."""
    rng = np.random.default_rng(8)
    spots = rng.integers(-scale, scale + 1, (30, 16))
    x = spots[rng.integers(0, 30, 4000)] + rng.integers(-scale // 3 - 1, scale // 3 + 2, (4000, 16))
    x = np.clip(x, -(1 << 27) + 1, (1 << 27) - 1)
    rounds = [x[:30].copy()]
    state, computed = None, 0
    for _ in range(8):
        past = ns_bounds.History(rounds)
        if state is None:
            state = past.first(x)
        else:
            *state, n = past.update(x, *state)
            computed += n
        true = ((x[:, None, :] - past.now[None].astype(object)) ** 2).sum(2) if scale > 1 << 20 else ((x[:, None, :] - past.now) ** 2).sum(2)
        assert (state[0] == np.array(true.argmin(1), np.int64)).all()
        low = state[1] - past.moved[np.arange(30), state[2]]
        assert (low.astype(float) <= np.sqrt(true.astype(float)) * (1 + 2 * ns_bounds.SLACK) + ns_bounds.SLACK).all()
        rounds.append(np.stack([x[state[0] == j].sum(0) // max((state[0] == j).sum(), 1) if (state[0] == j).any() else past.now[j]
                                for j in range(30)]))
    assert computed < 0.5 * 7 * 4000 * 30
