"""k-means on fixed-point vectors with norm-of-sum bounds.

Every vector keeps, for every centroid, the distance when it was last computed
and the round of that. A stored distance bounds today's from below after
taking off the norm of the centroid's *total* displacement since that round
(and from above after adding it), looked up in the retained history of
centroids; a sum of drifts round by round would loosen it more. Where the
bounds cannot tell that the old centroid is still the nearest, exactly the
centroids whose bounds fail are computed anew, in whole numbers.

Vectors and bounds are rows of a written table, replaced every round; sums of
clusters are reduced inside the tasks and then by a partial aggregate, so that
k rows of totals reach the driver, whatever the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alternating, staged

#: Components of a vector, centroids, rounds and the seed of the first centroids.
DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
#: Fixed point: floor(SCALE * x).
SCALE = 256
#: Largest fixed-point component: squared distances of 64 such stay in a long.
LIMIT = 1 << 27
#: Slack of bounds, relative and absolute: they are kept in single precision.
SLACK = 1e-6
#: Rows whose distances a task holds at once.
ROWS = 1024


def fixed_point(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding",
                dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows (key, vec) of all whole vectors, ``vec`` an array<int> of floor(256 * x).

    Left out: null vectors, other lengths, and those with a null or non-finite
    component. A component of 2**27 / 256 or more is an error: squared distances
    would not fit a long.
    """
    x = F.col(embedding)
    whole = (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    big = F.exists(x, lambda c: F.abs(c.cast("double") * SCALE) >= LIMIT)
    vec = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col(key).alias("key"),
        F.when(big, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
        .otherwise(vec).alias("vec"))


def first_centroids(points: DataFrame, clusters: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and key; equal keys by the vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    top = points.select(digest.alias("digest"), "vec").orderBy("digest", "vec").limit(clusters).collect()
    return np.array([r.vec for r in top], np.int64).reshape(len(top), dimensions)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows of points to rows of centroids as exact whole numbers.

    Through floating-point products where none of them can pass 2**53, else through longs.
    """
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = float if points.shape[1] * largest * largest < 1 << 51 else np.int64
    p, c = points.astype(exact), centroids.astype(exact)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


class History:
    """Centroids of every round so far, and how far each has come since each round."""

    def __init__(self, rounds: list[np.ndarray]):
        self.now, self.round = rounds[-1], len(rounds) - 1
        self.moved = np.stack([np.sqrt(((rounds[-1] - old).astype(float) ** 2).sum(1)) for old in rounds], axis=1)

    def first(self, points: np.ndarray):
        """(cluster, lower, seen) of vectors never seen: all distances."""
        d = distances(points, self.now)
        return d.argmin(1), _below(d), np.full(d.shape, self.round, np.uint16)

    def update(self, points: np.ndarray, cluster: np.ndarray, lower: np.ndarray, seen: np.ndarray):
        """New (cluster, lower, seen) and how many distances were computed.

        ``lower`` holds distances when last computed, rounded down; ``seen``
        the rounds. Ties go to the smaller number: a centroid is passed over
        only if it is farther beyond doubt.
        """
        rows, ks = np.arange(len(points)), np.arange(len(self.now))
        shift = self.moved[ks, seen]
        low = (lower - shift) * (1 - SLACK) - SLACK
        own = lower[rows, cluster].astype(float)
        high = (own + shift[rows, cluster]) * (1 + SLACK) + SLACK
        low[rows, cluster] = np.inf
        fails = np.flatnonzero(low.min(1, initial=np.inf) <= high)
        cluster, lower, seen = cluster.copy(), lower.copy(), seen.copy()
        if not len(fails):
            return cluster, lower, seen, 0
        mine = _pairs(points[fails], self.now[cluster[fails]])
        lower[fails, cluster[fails]], seen[fails, cluster[fails]] = _below(mine), self.round
        high = np.sqrt(mine.astype(float)) * (1 + SLACK) + SLACK
        near = low[fails] <= high[:, None]  # the old centroid is infinite here
        i, j = np.nonzero(near)
        other = _pairs(points[fails[i]], self.now[j])
        lower[fails[i], j], seen[fails[i], j] = _below(other), self.round
        best = np.full((len(fails), len(self.now)), np.iinfo(np.int64).max)
        best[i, j] = other
        best[np.arange(len(fails)), cluster[fails]] = mine
        cluster[fails] = best.argmin(1)
        return cluster, lower, seen, len(fails) + len(i)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row."""
    return ((a - b) ** 2).sum(1)


def _below(squares: np.ndarray) -> np.ndarray:
    """Square roots in single precision, rounded down."""
    return np.nextafter(np.sqrt(squares.astype(float)).astype(np.float32), np.float32(-np.inf))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros((0, width), kind)
    return np.frombuffer(data, kind, len(column) * width, int(offsets[column.offset])).reshape(-1, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(matrix)
    size = data.shape[1] * data.itemsize
    ends = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _parts(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def cluster(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (key, cluster, distance) of all whole vectors, and the centroids of every round.

    Starts from the vectors with the smallest digests of ``seed`` and key.
    ``rounds`` times all vectors go to their nearest centroid (ties: smaller
    number) and centroids that have vectors to their exact mean, rounded down;
    then all are assigned once more. ``distance`` is squared. Repeated rows and
    null keys are vectors like any other; other columns are ignored; no whole
    vector gives an empty result. The state of a round replaces that of the
    round before the last, so two are on disk at a time.
    """
    spark = vectors.sparkSession
    name = key
    kind = vectors.schema[key].dataType.simpleString()
    points = staged(fixed_point(vectors, key, embedding, dimensions), "points")
    history = [first_centroids(points, clusters, seed, dimensions)]
    k = len(history[0])
    if not k:
        return spark.createDataFrame([], f"`{name}` {kind}, cluster int, distance long"), history
    tables = alternating(spark, "bounds")

    def assign(frame, seen_before):
        past = History(history)
        width = dimensions

        def run(batches):
            for b in _parts(batches):
                if seen_before:
                    x = _matrix(b.column(1), "<i4", width).astype(np.int64)
                    state = past.update(x, b.column(2).to_numpy().astype(np.int64), _matrix(b.column(3), "<f4", k),
                                        _matrix(b.column(4), "<u2", k))[:3]
                    vec = b.column(1)
                else:
                    flat = b.column(1).flatten().to_numpy().reshape(-1, width)
                    state, vec = past.first(flat.astype(np.int64)), _binary(flat.astype("<i4"))
                c, lower, seen = state
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), vec, pa.array(c, pa.int32()), _binary(lower.astype("<f4")), _binary(seen.astype("<u2"))],
                    names=["key", "vec", "cluster", "lower", "seen"])
        return frame.mapInArrow(run, f"key {kind}, vec binary, cluster int, lower binary, seen binary")

    state = tables(assign(points, False))
    for _ in range(rounds):
        history.append(means(state, history[-1], dimensions))
        state = tables(assign(state, True))
    final = history[-1]

    def measure(batches):
        for b in _parts(batches):
            c = b.column(2).to_numpy()
            x = _matrix(b.column(1), "<i4", dimensions).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_pairs(x, final[c]))],
                                             names=[name, "cluster", "distance"])

    out = state.select("key", "vec", "cluster").mapInArrow(measure, f"`{name}` {kind}, cluster int, distance long")
    return staged(out, "clusters"), history


def means(state: DataFrame, before: np.ndarray, dimensions: int) -> np.ndarray:
    """The exact means, rounded down, of the vectors of each cluster; those without vectors stay."""
    k = len(before)

    def run(batches):
        total, n = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for b in _parts(batches):
            x, c = _matrix(b.column(0), "<i4", dimensions).astype(np.int64), b.column(1).to_numpy()
            member = (c[:, None] == np.arange(k)).astype(float)
            total += (member.T @ x.astype(float)).astype(np.int64)  # sums of ROWS components stay whole in doubles
            n += np.bincount(c, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    parts = state.select("vec", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    wide = "decimal(38,0)"
    sums = parts.groupBy("cluster").agg(
        F.sum(F.col("n").cast(wide)).alias("n"),
        *[F.sum(F.get("total", F.lit(i)).cast(wide)).alias(f"t{i}") for i in range(dimensions)])
    after = before.copy()
    for row in sums.collect():  # at most k rows
        after[row[0]] = [int(t) // int(row[1]) for t in row[2:]]
    return after


def summary(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256; k rows are broadcast. Sums beyond a long are an error."""
    spark = found.sparkSession
    wide = "decimal(38,0)"
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, total, sum(sums.values()), digests[c]) for c, total in sorted(sums.items())]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster")
