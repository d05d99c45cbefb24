"""Near-duplicates by one-permutation hashing, banded buckets and star candidates.

1. Every text becomes its set of word shingles, one hash permutation of which
   gives a signature of ``BINS`` bins; an empty bin borrows from the first
   non-empty one of a fixed random order of its own (optimal densification).
   Texts of one set are one node.
2. Bands of the signature are bucket keys. Each bucket links its nodes to one
   centre, as a star: if the signatures look alike (``ALIKE``) that is an edge.
   Nodes far from the centre (``FAR``) are compared among themselves, in
   blocks of ``BLOCK``, and also give stars only. A pair over the threshold
   misses all bands once in 10**7 and both comparisons far more rarely.
3. The components of these edges bound where links can be. Inside them full
   sets are compared, in blocks, and confirmed links are emitted as the
   star of each block's components; their components are the result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EDGE_BYTES, checked_broadcast, components, fresh, slices, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bins of the signature and rows of a band: 32 bands of 4.
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Agreeing bins (of 128) from which nodes count as alike, and below which as far from a centre.
ALIKE, FAR = 54, 80
#: Nodes of one block of comparisons.
BLOCK = 1024
SET_BLOCK = 256
#: Bytes of a row, at most, of the set keys, of the band keys with signatures, and of what the choice of first rows joins.
KEY_BYTES, SKETCH_BYTES, FIRST_BYTES = 64, 8 * (BANDS + BINS // 16) + 32, 64
#: Words whose hashes a Python worker remembers.
MEMORY_WORDS = 100_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONES = 0x1111111111111111


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD1
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """Shingle sets as sorted hashes, and their signatures."""

    def __init__(self, size: int):
        self.size, self.words = size, {}
        order = np.arange(1, BINS * BINS + 1, dtype=np.uint64).reshape(BINS, BINS)
        self.donors = np.argsort(_mix(order), axis=1, kind="stable")  # for each bin an order of all bins
        self.edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word shingles; one of the whole if there are fewer words."""
        words = WORD.findall(text.translate(_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > MEMORY_WORDS:
            self.words = {}
        hashes = list(map(self.words.get, words))
        if None in hashes:
            for w in set(words).difference(self.words):
                self.words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes = list(map(self.words.__getitem__, words))
        h = np.array(hashes, np.uint64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mix(out * _ODD2 + h[i:i + n])
        return np.unique(out)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Smallest hash of each bin of a set that is not empty, empty bins filled."""
        at = np.searchsorted(s, self.edges)
        full = at < np.append(at[1:], len(s))
        sig = s[np.minimum(at, len(s) - 1)]
        if not full.all():
            lender = self.donors[np.arange(BINS), full[self.donors].argmax(axis=1)]
            sig = np.where(full, sig, sig[lender])
        return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signature, the band's number mixed in."""
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _ODD2 + sig[i::ROWS])
    return key


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each bin, 16 bins to a 64-bit number."""
    bits = (_mix(sig) & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=1)


def agreeing(a: Column, b: Column) -> Column:
    """Bins in which two packed signatures agree."""
    out = F.lit(BINS)
    for i in range(BINS // 16):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for k in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        out = out - F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for two matrices of packed signatures: a matrix of counts."""
    out = np.full((len(a), len(b)), BINS, np.int64)
    for i in range(a.shape[1]):
        x = a[:, i][:, None] ^ b[:, i][None]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        out -= np.bitwise_count(x & np.uint64(_ONES))
    return out


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        """Put ``i`` and ``others`` into one group, named by its smallest member."""
        names = np.unique(np.append(self.label[others], self.label[i]))
        if len(names) > 1:
            self.label[np.isin(self.label, names[1:])] = names[0]

    def stars(self, ids: np.ndarray):
        """(member, centre) of every group of two or more."""
        moved = self.label != np.arange(len(self.label))
        return ids[moved], ids[self.label[moved]]


def _alike_block(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node", kind="stable")
    ids = part["node"].to_numpy()
    sigs = np.stack([np.asarray(x, np.int64) for x in part["sig"]]).view(np.uint64)
    groups = Groups(len(ids))
    for at in range(0, len(ids), 128):
        close = _agreeing(sigs[at:at + 128], sigs) >= ALIKE
        for i in range(len(close)):
            near = np.flatnonzero(close[i, at + i + 1:]) + at + i + 1
            if len(near):
                groups.join(at + i, near)
    a, b = groups.stars(ids)
    return pd.DataFrame({"a": a, "b": b})


def _linked_block(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        ids = part["node"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in part["shingles"]]
        size = np.array([len(x) for x in sets])
        groups = Groups(len(ids))
        for i in range(len(ids)):
            later = np.arange(i + 1, len(ids))
            later = later[groups.label[later] != groups.label[i]]
            later = later[100 * np.minimum(size[later], size[i]) >= percent * np.maximum(size[later], size[i])]
            if not len(later):
                continue
            own, joined = sets[i], np.concatenate([sets[j] for j in later])
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            starts = np.concatenate([[0], np.cumsum(size[later])[:-1]])
            common = np.add.reduceat((own[at] == joined).astype(np.int64), starts)
            linked = later[100 * common >= percent * (size[later] + size[i] - common)]
            if len(linked):
                groups.join(i, linked)
        a, b = groups.stars(ids)
        return pd.DataFrame({"a": a, "b": b})
    return run


def in_blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of each key dealt into parts of about ``size``, and each pair of parts made a block.

    Adds i and j (the block's parts). A key of one part is one block, each of
    its rows once; a key of p parts has p (p + 1) / 2 blocks, each of its rows
    in p of them.
    """
    large = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
             .select(key, F.ceil(F.col("n") / size).cast("int").alias("parts")))
    d = df.join(checked_broadcast(staged(large, "large-keys"), 24), key, "left")  # few: each has over ``size`` rows
    d = d.withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    d = d.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return (d.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
            .drop("part", "other", "parts"))


def sketch(docs: DataFrame, text: str, size: int, rid: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with row id, number of shingles, set key, band keys and packed signature, and the last four's names."""
    src = docs.withColumn(rid, F.monotonically_increasing_id())
    names = fresh(docs, "n_shingles", "_set_key", "_bands", "_sig")
    types = ["bigint", "string", "array<bigint>", "array<bigint>"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema]
                       + [f"`{name}` {kind}" for name, kind in zip(names, types, strict=True)])
    columns, where = src.columns, src.columns.index(text)

    def run(batches):
        s = Sketcher(size)
        for b in slices(batches):
            count, keys, bands, sigs = [], [], [], []
            for t in b.column(where).to_pylist():
                x = s.shingles(t or "")
                count.append(len(x))
                if len(x):
                    sig = s.signature(x)
                    keys.append(xxhash.xxh3_128_hexdigest(x.tobytes()))
                    bands.append(band_keys(sig).view(np.int64))
                    sigs.append(packed(sig).view(np.int64))
                else:
                    keys.append(None), bands.append(None), sigs.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(count, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, longs),
                 pa.array(sigs, longs)], names=[*columns, *names])

    return staged(src.mapInArrow(run, schema), "sketches"), names


def _sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """Rows (node, cluster, text) with the text's shingle set in the text's place."""
    def run(batches):
        s = Sketcher(size)
        for b in slices(batches):
            sets = [s.shingles(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())],
                                             names=["node", "cluster", "shingles"])
    return df.select("node", "cluster", text).mapInArrow(run, "node bigint, cluster bigint, shingles binary")


def alike(nodes: DataFrame) -> DataFrame:
    """Star edges (a, b) between nodes (node, bands, sig) that share a band and look alike."""
    rows = staged(nodes.select("node", F.posexplode("bands").alias("band", "key")), "buckets")
    first = F.struct(F.xxhash64("node", "band").alias("draw"), F.col("node"))
    centres = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("c"))
               .where("n > 1").select("key", F.col("c.node").alias("centre")))
    stars = rows.join(centres, "key").where("node <> centre").select("key", "node", "centre")
    sigs = nodes.select("node", "sig")
    stars = (stars.join(sigs, "node")
             .join(sigs.select(F.col("node").alias("centre"), F.col("sig").alias("centre_sig")), "centre"))
    stars = staged(stars.select("key", "node", "centre", "sig", agreeing(F.col("sig"), F.col("centre_sig")).alias("same")),
                   "stars")
    edges = stars.where(F.col("same") >= ALIKE).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    far = stars.where(F.col("same") < FAR).select("key", "node", "sig")
    twos = far.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    blocks = in_blocks(far.join(twos, "key", "left_semi"), "key", BLOCK)
    rest = blocks.groupBy("key", "i", "j").applyInPandas(_alike_block, "a bigint, b bigint")
    return edges.union(rest)


def _roots(docs: DataFrame, text: str, size: int, percent: int) -> tuple[DataFrame, list[str], DataFrame]:
    """The sketched rows, the names of row id, number of shingles and set key, and (_key, _root) of each set."""
    (rid,) = fresh(docs, "_row")
    full, (n, set_key, bands, sig) = sketch(docs, text, size, rid)
    copies = staged(full.where(F.col(n) > 0).groupBy(F.col(set_key).alias("set_key")).agg(F.min(rid).alias("node")),
                    "nodes", KEY_BYTES * full.count())
    chosen = full.select(F.col(rid).alias("node"), F.col(bands).alias("bands"), F.col(sig).alias("sig"))
    nodes = staged(chosen.join(copies.select("node"), "node", "left_semi"), "node-sketches", SKETCH_BYTES * copies.count())
    edges = staged(alike(nodes), "alike")
    n_edges = edges.count()
    clusters = components(edges, "a", "b", "alike", n_edges)
    several = staged(clusters.select("node", F.col("root").alias("cluster")), "clusters", EDGE_BYTES * 2 * n_edges)
    texts = full.select(F.col(rid).alias("node"), F.col(text).alias("body"))
    texts = texts.join(checked_broadcast(several, 32), "node")
    sets = staged(_sets(texts, "body", size), "sets")
    links = (in_blocks(sets, "cluster", SET_BLOCK).groupBy("cluster", "i", "j")
             .applyInPandas(_linked_block(percent), "a bigint, b bigint"))
    links = staged(links, "links")
    linked = components(links, "a", "b", "linked", links.count())
    roots = copies.join(linked, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    key, root = fresh(full, "_key", "_root")
    return full, [rid, n, set_key], roots.select(F.col("set_key").alias(key), F.col("root").alias(root))


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, list[str]]:
    """``docs`` with the row's id, its number of shingles and its component.

    Returns the frame and the three names (fresh ones). Two rows are linked
    when 100 * intersection >= percent * union of their sets of
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle);
    the component is the smallest row id reachable. Rows without words, null
    texts among them, are linked with nothing. Equal rows share a component;
    an empty table gives an empty result.
    """
    full, (rid, n, set_key), roots = _roots(docs, text, size, percent)
    key, root = roots.columns
    (component,) = fresh(full, "_component")
    out = full.join(roots, F.col(set_key) == F.col(key), "left").withColumn(component, F.coalesce(root, rid))
    return out.select(*docs.columns, rid, n, component), [rid, n, component]


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest (key, row id), null keys last; the columns of ``docs``.

    Only ids and keys are shuffled; the ids of the rows that go are then taken
    out of the texts, by a broadcast if their counted size allows.
    """
    full, (rid, _, set_key), roots = _roots(docs, text, size, percent)
    own, root = roots.columns
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(rid).alias("rid"))
    rows = full.select(set_key, order.alias("row")).join(roots, F.col(set_key) == F.col(own)).select(root, "row")
    firsts = rows.groupBy(F.col(root).alias("of")).agg(F.min("row").alias("first"))
    gone = rows.join(firsts, (F.col(root) == F.col("of")) & (F.col("row.rid") != F.col("first.rid")))
    gone = staged(gone.select(F.col("row.rid").alias("gone")), "gone", FIRST_BYTES * full.count())
    return full.join(checked_broadcast(gone, 32), F.col(rid) == F.col("gone"), "left_anti").select(*docs.columns)
