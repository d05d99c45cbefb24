"""Sharding by a hierarchical weighted hash tree.

Leaves are shards below racks below regions. A document descends level by
level: every child of the node that it is in draws an exponential arrival time
from (document key, child name), divided by the child's weight (the sum of the
weights of its leaves), and the earliest child wins. A child whose weight does
not change keeps its draws, so a change of weights moves documents only into
or out of subtrees whose weights change.

A new shard joins as a region of its own (one rack, one shard). All other
nodes keep their weights, so only the new region's draws are new: documents
move into the new shard or stay. That is the law ``key``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, gapless_rank, staged

#: Shards that form the first regions of a tree; later ones are regions of their own.
BASE_SHARDS, REGIONS, RACKS = 8, 2, 2
#: The tree becomes one expression; more leaves than this are refused.
MAX_LEAVES = 4096


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight (capacity)."""
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n_shards: int, base: int = BASE_SHARDS) -> list[Leaf]:
    """The tree that a shard count stands for: ``tree(n + 1)`` is ``tree(n)`` and one region.

    ``base`` shards form the first regions and racks; a cluster keeps the
    base that it started with. There is no tree of fewer shards.
    """
    if not 1 <= base <= n_shards:
        raise ValueError(f"a tree of {base} first shards has that many or more, and one at least")
    per_region, per_rack = -(-base // REGIONS), -(-base // REGIONS // RACKS)
    return ([Leaf(f"g{s // per_region}", f"k{s // per_rack}", s) for s in range(base)]
            + [Leaf(f"x{s}", "k0", s) for s in range(base, n_shards)])


def arrival(key: Column, node: str, weight: float) -> Column:
    """Exponential arrival time of ``node`` for ``key``; a null key draws like any other value."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(2 ** 53)) / F.lit(float(weight))


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that ``key`` descends to. Leaves of weight 0 get nothing."""
    leaves = [x for x in leaves if x.weight > 0]
    if not 0 < len(leaves) <= MAX_LEAVES:
        raise ValueError(f"1 to {MAX_LEAVES} leaves of positive weight are needed")
    if len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("shard numbers repeat")

    def descend(below: list[Leaf], names, path: str) -> Column:
        if not names:
            return F.lit(below[0].shard)
        children: dict = {}
        for x in below:
            children.setdefault(names[0](x), []).append(x)
        subtrees = {c: descend(v, names[1:], f"{path}/{c}") for c, v in children.items()}
        if len(children) == 1:
            return next(iter(subtrees.values()))
        first = F.array_min(F.array(*[
            F.struct(arrival(key, f"{path}/{c}", sum(x.weight for x in v)).alias("at"), F.lit(i).alias("i"))
            for i, (c, v) in enumerate(children.items())]))["i"]
        out = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(children))):
            out = F.when(first == i, subtrees[c]).otherwise(out)
        return out

    return descend(leaves, (lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)), "").cast("int")


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = BASE_SHARDS,
          base: int = BASE_SHARDS) -> DataFrame:
    """Place every row of ``docs`` into shards 0 to ``n_shards`` - 1.

    Returns one row for each row of ``docs``: the key column, size (UTF-8
    bytes of the text, none for null, plus 1), text_crc32, law, shard, slot
    (gapless from 0 inside a shard), grown_shard (the shard under one more),
    region and rack. Only these digests are shuffled, never texts. Rows
    with equal keys, null included, share a shard; repeated rows each get a
    slot; other columns are ignored; an empty table gives an empty result.
    """
    leaves = tree(n_shards, base)
    (rid,) = fresh(docs, "_rid")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    digests = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(F.col(key), leaves).alias("shard"),
        shard_of(F.col(key), tree(n_shards + 1, base)).alias("grown_shard"),
        F.monotonically_increasing_id().alias(rid))
    out = gapless_rank(staged(digests, "hash-tree"), ["shard"], rid, "slot")
    names = F.create_map(*[F.lit(v) for x in leaves for v in (x.shard, f"{x.region}/{x.rack}")])
    where = F.split(names[F.col("shard")], "/")
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
                      "grown_shard", where[0].alias("region"), where[1].alias("rack"))
