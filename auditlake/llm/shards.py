"""Best-fit-decreasing packing of indivisible groups of equal texts into a fixed number of shards.

Groups are packed by their summed size. The driver never sees them all: a group above a share of the total size is an item of
its own (so there are at most so many), all others are bundled by hash into a fixed number of parcels, a small part
of them into far smaller parcels that fill the last gaps. Items enter, in falling size, the tightest bin that still
holds them, found in a balanced tree by remaining room; the smallest capacity at which the bins suffice is searched.
An item above an even share gets a bin of its own, and the others share what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import stored

SHARDS = 40
OVERHEAD = 16
ITEMS_PER_SHARD = 128
FINE = 64
UNITS = 8192


class Tree:
    """A height-balanced search tree of distinct comparable keys."""

    __slots__ = ("root",)

    def __init__(self, keys=()):
        self.root = None
        for key in keys:
            self.add(key)

    def add(self, key) -> None:
        self.root = _add(self.root, key)

    def remove(self, key) -> None:
        self.root = _remove(self.root, key)

    def least_from(self, key):
        """The smallest key that is not below ``key``, or None."""
        node, best = self.root, None
        while node:
            if node[0] >= key:
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best


def _height(node) -> int:
    return node[3] if node else 0


def _node(key, left, right) -> tuple:
    return key, left, right, 1 + max(_height(left), _height(right))


def _balanced(key, left, right) -> tuple:
    if _height(left) > _height(right) + 1:
        k, a, b, _ = left
        if _height(a) >= _height(b):
            return _node(k, a, _node(key, b, right))
        return _node(b[0], _node(k, a, b[1]), _node(key, b[2], right))
    if _height(right) > _height(left) + 1:
        k, a, b, _ = right
        if _height(b) >= _height(a):
            return _node(k, _node(key, left, a), b)
        return _node(a[0], _node(key, left, a[1]), _node(k, a[2], b))
    return _node(key, left, right)


def _add(node, key):
    if not node:
        return _node(key, None, None)
    k, left, right, _ = node
    return _balanced(k, _add(left, key), right) if key < k else _balanced(k, left, _add(right, key))


def _remove(node, key):
    k, left, right, _ = node
    if key < k:
        return _balanced(k, _remove(left, key), right)
    if key > k:
        return _balanced(k, left, _remove(right, key))
    if not left or not right:
        return left or right
    least = right
    while least[1]:
        least = least[1]
    return _balanced(least[0], left, _remove(right, least[0]))


def best_fit(sizes: list[int], bins: int, capacity: int) -> list[int] | None:
    """A bin for each of the falling ``sizes``, or None if they don't fit."""
    room = Tree((capacity, b) for b in range(bins))
    chosen = []
    for size in sizes:
        tightest = room.least_from((size, -1))
        if tightest is None:
            return None
        room.remove(tightest)
        room.add((tightest[0] - size, tightest[1]))
        chosen.append(tightest[1])
    return chosen


def pack(items: dict, bins: int) -> dict:
    """Item to bin, for sizes by item, at the smallest capacity found (to 1 in 10,000)."""
    order = sorted(items, key=lambda k: (-items[k], k))
    chosen, rest = {}, sum(items.values())
    first = 0
    while first < len(order) and bins - first > 1 and items[order[first]] * (bins - first) > rest:
        chosen[order[first]] = first
        rest -= items[order[first]]
        first += 1
    left = order[first:]
    if not left:
        return chosen
    sizes, n = [items[k] for k in left], bins - first
    low = max(-(-rest // n), sizes[0])
    best, step = best_fit(sizes, n, low), 1 + low // 10_000
    high = low
    while best is None:
        high += step
        step *= 2
        best = best_fit(sizes, n, high)
    while best and high - low > 1 + low // 10_000:
        middle = (low + high) // 2
        tried = best_fit(sizes, n, middle)
        if tried is None:
            low = middle
        else:
            high, best = middle, tried
    return chosen | {k: first + b for k, b in zip(left, best)}


@dataclass(frozen=True)
class Sizes:
    rows: int
    bytes: int


def shards(docs: DataFrame, n: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; law is always "bytes".

    Equal texts share a shard; a null text counts as an empty one. Slots run from 0 without gaps in each shard.
    Null and repeated ids are rows of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")))
    total = Sizes(*(x or 0 for x in rows.agg(F.count("*"), F.sum("size")).first()))
    parcels = n * ITEMS_PER_SHARD
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    large = [r["h"] for r in groups.where(F.col("bytes") * F.lit(parcels) > F.lit(total.bytes)).select("h").collect()]  # fewer than ``parcels``
    marked = rows.join(F.broadcast(spark.createDataFrame([(h, i) for i, h in enumerate(large)], "h long, own int")), "h", "left")
    coarse = F.pmod(F.shiftright("h", 8), F.lit(parcels))
    fine = F.pmod(F.col("h"), F.lit(FINE)) == 0
    item = F.when(F.col("own").isNotNull(), F.col("own")).when(fine, parcels + coarse).otherwise(2 * parcels + coarse).cast("int")
    salts = max(1, -(-total.rows // UNITS))  # rows of a unit, about
    marked = marked.withColumn("item", item)
    per_item = marked.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most 3 * parcels
    shard_of = pack({r["item"]: r["bytes"] for r in per_item}, n)
    layout = spark.createDataFrame([(r["item"], shard_of[r["item"]], -(-r["n"] // salts)) for r in per_item], "item int, shard int, units int")
    placed = marked.join(F.broadcast(layout), "item").withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.col("units")).cast("int"))
    counts = placed.groupBy("shard", "item", "unit").count()  # at most UNITS and 3 * parcels rows
    before = Window.partitionBy("shard").orderBy("item", "unit").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("item", "unit", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("item", "unit").orderBy("doc_id", "h")) - 1
    return placed.withColumn("within", within).join(F.broadcast(bases), ["item", "unit"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
