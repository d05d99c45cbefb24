"""Packing tokenised documents into sequences by column generation.

Documents are cut into whole sequences and a rest. The rests' histogram of
lengths (at most ``CAPACITY`` numbers, whatever the corpus) is a cutting-stock
problem: a linear program over patterns, whose columns a knapsack by dynamic
programming prices. Lengths are grouped into at most ``CLASSES`` classes, each
priced at its longest, cut where that wastes least: up to ``CLASSES`` different
lengths, or any frequent one, are priced exactly. Patterns are rounded down
and what is left is classed and priced anew, while it is much. The last rest, and pieces of at most ``SMALL`` tokens, goes by exact length into the
narrowest gap that takes it, longest first. The plan speaks of ranks
only ("ranks 10 to 90 of length 700 go to sequences 5 to 85 at offset 1400");
pieces are ranked inside their length on Spark and looked up.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, gapless_rank, slices, staged
from .word_bpe import codec, default_vocabulary, steps

CAPACITY = 4096
#: Classes of lengths, rows of the linear program.
CLASSES = 128
SMALL = 64
#: Id that ends every document.
END_ID = 2
#: Simplex steps; a program stopped here is feasible, only less tight.
MAX_STEPS = 20_000
#: Pieces a class, on average, up to which no program is solved.
FEW = 4
#: A program this near its bound is solved.
TIGHT = 1e-3


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
        capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens) of every document, whole sequences first.

    Null or empty text is the end id alone. Ids stay in the task.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    full = 4 * capacity
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        bpe = codec(path)
        for batch in slices(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            rest = [b""] * len(texts)
            found: list[list[tuple[int, int]]] = [[] for _ in texts]  # (length, crc) of each document's pieces
            for part in steps(texts):
                for (i, _), coded in zip(part, bpe.coded([c for _, c in part]), strict=True):
                    data = rest[i] + coded
                    at = 0
                    while len(data) - at >= full:
                        found[i].append((capacity, zlib.crc32(data[at:at + full])))
                        at += full
                    rest[i] = data[at:]
            row, start, length, crc, total = [], [], [], [], []
            for i, own in enumerate(found):
                own.append(((len(rest[i]) + 4) // 4, zlib.crc32(rest[i] + end)))
                tokens, at = sum(n for n, _ in own), 0
                for n, c in own:
                    row.append(i), start.append(at), length.append(n), crc.append(c), total.append(tokens)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, schema)


def classes(histogram: dict[int, int], most: int = CLASSES) -> list[list[int]]:
    """Lengths in at most ``most`` runs of neighbours, longest first in each.

    Starts with one run and cuts where the tokens lost by counting each piece
    at its run's longest shrink most.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    pieces = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths.tolist()])])

    def best(a: int, b: int):
        """(minus what the best cut of lengths[a:b] saves, a, b, the cut)."""
        if b - a < 2:
            return 0, a, b, a
        saved = (lengths[b - 1] - lengths[a:b - 1]) * (pieces[a + 1:b] - pieces[a])
        i = int(np.argmax(saved))
        return -int(saved[i]), a, b, a + 1 + i

    heap, done = [best(0, len(lengths))], []
    while heap and len(heap) + len(done) < most:
        saved, a, b, cut = heapq.heappop(heap)
        if not saved:
            done.append((0, a, b, cut))
            continue
        heapq.heappush(heap, best(a, cut))
        heapq.heappush(heap, best(cut, b))
    return [lengths[a:b][::-1].tolist() for _, a, b, _ in sorted(heap + done, key=lambda x: x[1])]


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern: how many of each size (ascending) fit into ``capacity`` with the greatest sum of values."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.flatnonzero(values > 0).tolist():
        s, v = int(sizes[i]), values[i]
        for a in range(s, capacity + 1, s):  # a stretch reads only what the one before it wrote
            b = min(a + s, capacity + 1)
            worth = best[a - s:b - s] + v
            more = worth > best[a:b]
            best[a:b][more], took[a:b][more] = worth[more], i
    pattern = np.zeros(len(sizes), np.int64)
    c = int(np.argmax(best))
    top = float(best[c])
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return top, pattern


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities: the linear program's optimum, rounded down.

    counts[i] pieces of sizes[i] (ascending). Columns enter a revised simplex
    one by one, each the best of the knapsack.
    """
    m = len(sizes)
    if not m:
        return []
    n = counts.astype(float)
    columns = np.diag((capacity // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1 / np.diag(columns))
    x = inverse @ n
    for step in range(MAX_STEPS):
        if step % 200 == 199:  # fresh digits
            inverse = np.linalg.inv(columns)
            x = inverse @ n
        dual = cost @ inverse
        i = int(np.argmin(dual))
        if dual[i] < -1e-9:  # more of a class than there are pieces
            column, c = np.zeros(m), 0.0
            column[i] = -1
        else:
            worth, pattern = price(sizes, dual, capacity)
            if worth <= 1 + TIGHT:
                break
            column, c = pattern.astype(float), 1.0
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out], cost[out] = column, c
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        x -= ratio[out] * direction
        x[out] = ratio[out]
    return [(np.rint(columns[:, j]).astype(np.int64), times) for j in range(m)
            if cost[j] and (times := int(np.floor(x[j] + 1e-6))) > 0]


class Plan:
    """Where each rank of each length goes: rows (length, first, until, per, sequence, offset).

    Rank r of a length, first <= r < until, lies in sequence + (r - first) // per
    at offset + (r - first) % per * length.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left, self.next = dict(histogram), defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
        if capacity in self.left:
            self._put(capacity, self.left[capacity], 1, self._open(self.left[capacity]), 0)
        while self._price():
            pass
        for n in sorted((n for n, c in self.left.items() if c), reverse=True):
            self._fit(n)
        if any(self.left.values()):
            raise AssertionError("pieces without a place")

    def _price(self) -> bool:
        """Place pieces by patterns of the lengths that are left; whether any pattern came out whole.

        A program has as many patterns as classes: too few pieces for that are left to the gaps.
        """
        groups = classes({n: c for n, c in self.left.items() if n > SMALL and c})
        sizes = np.array([g[0] for g in groups], np.int64)
        counts = np.array([sum(self.left[n] for n in g) for g in groups], np.int64)
        if counts.sum() <= FEW * len(groups):
            return False
        made = patterns(sizes, counts, self.capacity)
        for pattern, times in made:
            filled = [(self._open(times), times, 0)]  # first sequence, how many, filled
            for i in np.flatnonzero(pattern)[::-1].tolist():
                for _ in range(int(pattern[i])):
                    filled = [g for old in filled for g in self._slot(old, groups[i])]
            for seq, n, used in filled:
                self._gap(self.capacity - used, seq, n)
        return bool(made)

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _gap(self, room: int, seq: int, n: int) -> None:
        if room and n:
            self.gaps[room].append((seq, n))

    def _put(self, length: int, n: int, per: int, seq: int, offset: int) -> None:
        first = self.next[length]
        self.rows.append((length, first, first + n, per, seq, offset))
        self.next[length] += n
        self.left[length] -= n

    def _slot(self, group, lengths):
        """Give each sequence of a group one piece of a class, the longest first; splits where lengths change."""
        seq, n, filled = group
        for length in lengths:
            take = min(n, self.left[length])
            if take:
                self._put(length, take, 1, seq, filled)
                yield seq, take, filled + length
                seq, n = seq + take, n - take
        if n:
            yield seq, n, filled

    def _fit(self, length: int) -> None:
        """All left pieces of a length into the narrowest gaps that take them, else into new sequences."""
        for room in sorted(r for r in self.gaps if r >= length):
            per, kept = room // length, []
            for seq, n in self.gaps.pop(room):
                q = self.left[length]
                if not q:
                    kept.append((seq, n))
                    continue
                whole, over = min(n, q // per), 0
                if whole:
                    self._put(length, whole * per, per, seq, self.capacity - room)
                    self._gap(room - per * length, seq, whole)
                if whole < n and self.left[length]:
                    over = self.left[length]  # fewer than per
                    self._put(length, over, per, seq + whole, self.capacity - room)
                    self._gap(room - over * length, seq + whole, 1)
                if n - whole - bool(over):
                    kept.append((seq + whole + bool(over), n - whole - bool(over)))
            if kept:
                self.gaps[room] += kept
            if not self.left[length]:
                return
        per, q = self.capacity // length, self.left[length]
        new = -(-q // per)
        seq = self._open(new)
        self._put(length, q, per, seq, 0)
        whole = q // per
        self._gap(self.capacity - per * length, seq, whole)
        if new > whole:
            self._gap(self.capacity - (q - whole * per) * length, seq + whole, 1)

    def lookup(self):
        """Sorted arrays for ``find``: key of the first rank, then per, sequence, offset."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return (rows[:, 0] << 48 | rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4], rows[:, 5])


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: the key column, start, length, ids_crc32,
    doc_tokens, sequence_id and offset. Every row of ``docs`` is a document of
    its own, also with a null or repeated key; null or empty text is the end id
    alone; other columns are ignored; an empty table gives an empty result.
    Only the histogram of lengths reaches the driver.
    """
    (rid, rank) = fresh(docs, "_rid", "_rank")
    p = staged(cut(docs, key, text, vocabulary, capacity, end_id)
               .withColumn(rid, F.monotonically_increasing_id()), "pieces")
    histogram = {int(n): int(c) for n, c in p.groupBy("length").count().collect()}  # at most ``capacity`` rows
    first, low, per, seq, offset = Plan(histogram, capacity).lookup()
    ranked = gapless_rank(p, ["length"], rid, rank).select(
        key, "start", "length", "ids_crc32", "doc_tokens", rank)

    def find(batches):
        for b in batches:
            length, r = (b.column(i).to_numpy().astype(np.int64) for i in (2, 5))
            at = np.searchsorted(first, length << 48 | r, side="right") - 1
            j = r - low[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq[at] + j // per[at]), pa.array(offset[at] + j % per[at] * length)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(find, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, "
                                   "doc_tokens bigint, sequence_id bigint, offset bigint")
