"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are turned to the principal axes of a sample, dealt into two halves of
equal variance; each half has a codebook of its own, and the product of the two
codebooks is a grid of cells. For a query the cells' squared distances are bounded
from below, half by half (distance to the bisector of the nearest and the other
centroid). The traversal takes cells by the sum of the two bounds, nearest first,
and stops at a radius. The radius is measured: the links of a bounded set of
probes with all vectors, found by brute force, say how far the traversal must go
to reach the target recall; pairs planted at the threshold say it where links
are few. Members of visited cells are verified by cosine in double precision, so
no pair below the threshold is ever linked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, staged

#: Codebooks are fitted to at most so many vectors (those of the smallest hashes); all are indexed.
SAMPLE = 20_000
#: Mean number of vectors of a cell, which sets the codebooks' size.
CELL = 512
LLOYD_STEPS = 12
#: Probes (of the sample's smallest hashes) whose links with all vectors are found by brute force.
PROBES = 512
#: Recall of the probes' links, each probe of equal weight, and of the pairs planted at the threshold.
TARGET, PLANTED_TARGET = 1.0, 0.95
#: Steps of the radius between 0 and the exact bound.
STEPS = 1024
#: Members and visitors of one block of comparisons.
MEMBERS, VISITORS = 1024, 4096


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids by Lloyd's steps, started at evenly spaced points; no randomness."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)]
    for _ in range(LLOYD_STEPS):
        near = squared(points, centres).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


class Grid:
    """The cells of two codebooks, fitted to the rows of ``points``."""

    def __init__(self, points: np.ndarray, k: int):
        centred = points - points.mean(axis=0)
        spread, axes = np.linalg.eigh(centred.T @ centred)
        self.cut = points.shape[1] // 2
        halves, load = ([], []), [0.0, 0.0]
        for axis in np.argsort(-spread, kind="stable"):
            full = [len(halves[0]) == self.cut, len(halves[1]) == points.shape[1] - self.cut]
            half = int(full[0] or not full[1] and load[1] < load[0])
            halves[half].append(axis)
            load[half] += max(spread[axis], 0)
        self.axes = axes[:, halves[0] + halves[1]]
        points = points @ self.axes
        self.books = (codebook(points[:, :self.cut], k), codebook(points[:, self.cut:], k))
        self.apart = [np.sqrt(squared(c, c)) for c in self.books]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each unit vector and the bounds of both halves."""
        x = x @ self.axes
        a, low_a = self.bounds(x[:, :self.cut], 0)
        b, low_b = self.bounds(x[:, self.cut:], 1)
        return a * len(self.books[1]) + b, low_a, low_b

    def needed(self, x, y) -> np.ndarray:
        """Radius at which the traversal meets the pairs of places ``x`` and ``y``: from the lower cell to the higher."""
        turn = x[0] > y[0]
        low, high = np.where(turn, y[0], x[0]), np.where(turn, x[0], y[0])
        i, rows = np.divmod(high, len(self.books[1])), np.arange(len(low))
        far = [np.where(turn, y[h + 1][rows, i[h]], x[h + 1][rows, i[h]]) for h in (0, 1)]
        return np.where(low == high, 0.0, far[0] + far[1])

    def bounds(self, x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, and lower bounds of the squared distance to any point of each centroid's region."""
        d = squared(x, self.books[half])
        own = d.argmin(axis=1)
        gap = d - d[np.arange(len(x)), own][:, None]
        apart = self.apart[half][own]
        low = np.where(apart > 0, gap / np.where(apart > 0, 2 * apart, 1), 0)
        return own, np.square(np.maximum(low - 1e-12, 0))

    def visits(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each unit vector, and the cells after it (by number) within ``radius``, nearest first.

        A pair of cells is only visited from the lower one, so each pair of
        vectors meets once.
        """
        own, low_a, low_b = self.place(x)
        width, out = len(self.books[1]), []
        for i in range(len(x)):
            rows = np.flatnonzero(low_a[i] <= radius)
            rows = rows[np.argsort(low_a[i][rows], kind="stable")]
            order = np.argsort(low_b[i], kind="stable")
            reach = np.searchsorted(low_b[i][order], radius - low_a[i][rows], side="right")
            cells = np.concatenate([r * width + order[:n] for r, n in zip(rows, reach, strict=True)])
            far = np.concatenate([low_a[i][r] + low_b[i][order[:n]] for r, n in zip(rows, reach, strict=True)])
            later = cells > own[i]
            out.append(cells[later][np.argsort(far[later], kind="stable")])
        return own, out


def units(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty or zero vectors and null or non-finite components."""
    out = []
    for v in vectors:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max() if len(x) else 0.0
        if not top or not np.isfinite(x).all():
            out.append(None)
            continue
        x = x / top  # no overflow in the squares
        out.append(x / np.sqrt(x @ x))
    return out


def planted(points: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Probes, and for each a unit vector at the threshold's cosine, away along the difference of two rows of ``points``."""
    n = len(points)
    probes = points[:PROBES]
    step = np.arange(len(probes))
    away = points[(step * 7 + n // 3) % n] - points[(step * 5 + 2 * n // 3 + 1) % n]
    away = away - (away * probes).sum(1)[:, None] * probes
    size = np.sqrt((away * away).sum(1))
    ok = size > 1e-9
    away = away[ok] / size[ok][:, None]
    return probes[ok], threshold * probes[ok] + math.sqrt(1 - threshold * threshold) * away


def step_of(need: np.ndarray, reach: float) -> np.ndarray:
    """Smallest step whose radius is no less than ``need``; steps are even in the root of the radius."""
    return np.clip(np.ceil(np.sqrt(np.maximum(need, 0) / reach) * STEPS - 1e-12), 0, STEPS).astype(np.int64)


def least_step(steps: np.ndarray, weights: np.ndarray, target: float) -> int:
    """Smallest step at which ``target`` of the weight is met."""
    if not len(steps):
        return 0
    got = np.cumsum(np.bincount(steps, weights, STEPS + 1))
    return int(np.searchsorted(got, target * got[-1] * (1 - 1e-12)))


def radii(nodes: DataFrame, sample: list, grids: dict[int, Grid], threshold: float) -> dict[int, tuple[float, float]]:
    """Length -> (radius of the traversal, measured recall of the probes' links there).

    ``nodes`` has node, unit and tag (a hash of the label); ``sample`` has rows of it. Each
    probe is compared with every vector of ``nodes``; a task returns the number
    of links by probe and step, never links, and the driver gets at most
    ``PROBES`` * (``STEPS`` + 1) rows of a length. 1 as recall if no probe has a link.
    """
    reach = 2 - 2 * threshold + 1e-9
    probes = {}
    for size, grid in grids.items():
        rows = [(x, r["node"], r["tag"]) for x, r in sample if len(x) == size][:PROBES]
        x = np.stack([r[0] for r in rows])
        probes[size] = (x, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), grid.place(x))

    def compare(batches):
        for b in batches:
            found = [np.frombuffer(x, "<f8") for x in b.column(1).to_pylist()]
            sizes, ids = np.array([len(x) for x in found], np.int64), b.column(0).to_numpy()
            tags = b.column(2).to_numpy()
            out = {}
            for size, (x, own_id, own_tag, place) in probes.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                y = np.stack([found[r] for r in rows])
                near = (y @ x.T >= threshold) & (tags[rows][:, None] == own_tag) & (ids[rows][:, None] != own_id)
                i, j = np.nonzero(near)
                if len(i):
                    grid = grids[size]
                    hit, back = np.unique(i, return_inverse=True)
                    there = [v[back] for v in grid.place(y[hit])]
                    steps = step_of(grid.needed([v[j] for v in place], there), reach)
                    keys, n = np.unique(j * (STEPS + 1) + steps, return_counts=True)
                    out[size] = (keys, n)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(k), s) for s, (k, _) in out.items()])),
                     pa.array(np.concatenate([k for k, _ in out.values()])),
                     pa.array(np.concatenate([n for _, n in out.values()]))], names=["size", "key", "n"])

    counts = (nodes.select("node", "unit", "tag").mapInArrow(compare, "size bigint, key bigint, n bigint")
              .groupBy("size", "key").agg(F.sum("n").alias("n")).collect())  # bounded by probes and steps
    out = {}
    for size, grid in grids.items():
        key = np.array([r["key"] for r in counts if r["size"] == size], np.int64)
        n = np.array([r["n"] for r in counts if r["size"] == size], np.float64)
        probe, steps = np.divmod(key, STEPS + 1)
        weight = n / np.bincount(probe, n, PROBES)[probe] if len(key) else n
        x, y = planted(np.stack([x for x, _ in sample if len(x) == size]), threshold)
        made = step_of(grid.needed(grid.place(x), grid.place(y)), reach)
        step = max(least_step(steps, weight, TARGET), least_step(made, np.ones(len(made)), PLANTED_TARGET))
        recall = float(weight[steps <= step].sum() / weight.sum()) if len(key) else 1.0
        out[size] = (reach * (step / STEPS) ** 2 + 1e-12, recall)
    return out


def _compared(threshold: float):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        i, j, k = (int(x) for x in key[-3:])
        part = part.sort_values(["visitor", "node"], kind="stable")
        ids, weight = part["node"].to_numpy(), part["copies"].to_numpy()
        x = np.stack([np.frombuffer(v, "<f8") for v in part["unit"]])
        visitor, side = part["visitor"].to_numpy(), part["part"].to_numpy()
        n = len(ids)
        links, label = np.zeros(n, np.int64), np.arange(n)
        members = int((~visitor).sum())
        for at in range(0, n, 512):
            rows = np.arange(at, min(at + 512, n))
            near = x[rows] @ x[:members].T >= threshold
            if i != j:  # two parts of one cell: across only
                near &= side[rows][:, None] != side[:members][None]
            elif k == 0:  # members among themselves once, visitors with members
                near &= (rows[:, None] != np.arange(members)[None])
            else:
                near &= visitor[rows][:, None]
            for r in np.flatnonzero(near.any(axis=1)):
                found = np.flatnonzero(near[r])
                row = rows[r]
                links[row] += weight[found].sum()
                if visitor[row]:
                    links[found] += weight[row]
                names = np.unique(np.append(label[found], label[row]))
                if len(names) > 1:
                    label[np.isin(label, names[1:])] = names[0]
        hit = links > 0
        return pd.DataFrame({"node": ids[hit], "links": links[hit], "centre": ids[label[hit]]})
    return run


def near_vectors(vectors: DataFrame, vec: str = "embedding", label: str = "label",
                 threshold: float = 0.93) -> tuple[DataFrame, list[str]]:
    """``vectors`` with row id, number of links and component (smallest row id reachable).

    Returns the frame and the three names (fresh ones). Vectors are compared
    only if labels are equal and not null and lengths are equal. Null, empty
    and zero vectors and such with null or non-finite components link with
    nothing. Equal vectors of a label are one node with a weight: each copy
    counts the others as links. Blocks return a row for each node, never
    pairs. All links of the probes are found (``radii`` measures it), others may be missed; a length of vectors
    that the sample lacks is one cell, whole. An empty table gives an empty result.
    """
    rid, key, unit, n_links, component = fresh(vectors, "_row", "_vector_key", "_unit", "n_links", "_component")
    src = vectors.withColumn(rid, F.monotonically_increasing_id())
    columns, where = src.columns, src.columns.index(vec)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema]
                       + [f"`{key}` string, `{unit}` binary"])

    def normalise(batches):
        for b in batches:
            found = units(b.column(where).to_pylist())
            keys = [None if x is None else xxhash.xxh3_128_hexdigest(x.tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(keys, pa.string()),
                 pa.array([None if x is None else x.tobytes() for x in found], pa.binary())],
                names=[*columns, key, unit])

    full = staged(src.mapInArrow(normalise, schema), "units")
    usable = full.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    groups = staged(usable.groupBy(F.col(label).alias("label"), F.col(key).alias("vector_key"))
                    .agg(F.min(rid).alias("node"), F.count(F.lit(1)).alias("copies")), "vector-nodes")
    nodes = full.select(F.col(rid).alias("node"), F.col(unit).alias("unit")).join(groups, "node")
    nodes = staged(nodes.withColumn("tag", F.xxhash64("label")), "vectors")
    count = nodes.count()
    half = math.ceil(math.sqrt(max(count, 1) / CELL))
    sample = [(np.frombuffer(r["unit"], "<f8"), r) for r in nodes.select("unit", "node", "tag")
              .orderBy(F.xxhash64("unit"), "node").limit(SAMPLE).collect()]  # bounded by SAMPLE
    grids = {size: Grid(np.stack([x for x, _ in sample if len(x) == size]), half)
             for size in sorted({len(x) for x, _ in sample})}
    reach = {size: r for size, (r, _) in radii(nodes, sample, grids, threshold).items()}

    def visit(batches):
        for b in batches:
            found = [np.frombuffer(x, "<f8") for x in b.column(1).to_pylist()]
            own, seen = np.zeros(len(found), np.int64), [np.zeros(0, np.int64) for _ in found]
            sizes = np.array([len(x) for x in found], np.int64)
            for size, grid in grids.items():  # a length that the sample lacks is one cell
                rows = np.flatnonzero(sizes == size)
                if len(rows):
                    own[rows], cells = grid.visits(np.stack([found[r] for r in rows]), reach[size])
                    for r, c in zip(rows, cells, strict=True):
                        seen[r] = c
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes), pa.array(own), pa.array(seen, pa.list_(pa.int64()))],
                names=["node", "unit", "label", "copies", "size", "cell", "visits"])

    kind = vectors.schema[label].dataType.simpleString()
    placed = staged(nodes.select("node", "unit", "label", "copies").mapInArrow(
        visit, f"node bigint, unit binary, label {kind}, copies bigint, size bigint, cell bigint, visits array<bigint>"),
        "cells")
    links = staged(_links(placed, threshold), "vector-links")
    roots = components(links.where("node <> centre"), "node", "centre", "vector-components")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    result = (groups.join(sums, "node", "left").join(roots, "node", "left")
              .select(F.col("label").alias("_l"), F.col("vector_key").alias("_k"),
                      (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias(n_links),
                      F.coalesce("root", "node").alias(component)))
    out = full.join(result, (full[key] == result["_k"]) & (full[label] == result["_l"]), "left")
    return out.select(*[full[c] for c in vectors.columns], full[rid], F.coalesce(n_links, F.lit(0)).alias(n_links),
                      F.coalesce(F.col(component), full[rid]).alias(component)), [rid, n_links, component]


def _links(placed: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, links, centre): links found in one block, and the smallest node of its component there.

    A cell's members are dealt into p parts and its visitors into q; each pair
    of member parts and each pair of a member and a visitor part is a block.
    """
    cell = ["label", "size", "cell"]
    member = placed.select("node", "unit", "copies", *cell)
    visitor = placed.select("node", "unit", "copies", "label", "size", F.explode("visits").alias("cell"))
    p = member.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("p"))
    q = (placed.select("label", "size", F.explode("visits").alias("cell")).groupBy(*cell)
         .agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("q")))
    shape = staged(p.join(q, cell, "left").select(*cell, "p", F.coalesce("q", F.lit(1)).alias("q")), "cell-parts")
    part = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda o: F.struct(
        F.least(o, part).alias("i"), F.greatest(o, part).alias("j"), F.lit(0).alias("k")))
    others = F.when(F.col("q") > 1, F.transform(F.sequence(F.lit(1), F.col("q") - 1), lambda k: F.struct(
        part.alias("i"), part.alias("j"), k.cast("int").alias("k")))).otherwise(
        F.array().cast("array<struct<i:int,j:int,k:int>>"))
    members = member.join(shape, cell).select(
        *cell, "node", "unit", "copies", F.lit(False).alias("visitor"), part.alias("part"),
        F.explode(F.concat(whole, others)).alias("b"))
    turn = F.pmod(F.xxhash64("node"), F.col("q")).cast("int")
    visitors = visitor.join(shape, cell).select(
        *cell, "node", "unit", "copies", F.lit(True).alias("visitor"), F.lit(-1).alias("part"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(
            i.cast("int").alias("i"), i.cast("int").alias("j"), turn.alias("k")))).alias("b"))
    rows = members.unionByName(visitors).select("*", "b.i", "b.j", "b.k").drop("b")
    return rows.groupBy(*cell, "i", "j", "k").applyInPandas(
        _compared(threshold), "node bigint, links bigint, centre bigint")
