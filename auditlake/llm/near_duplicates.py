"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped edges.

A text's set of shingles is a node; rows with equal sets share one. One hash of each shingle gives both its bin (top bits)
and its value, so the sorted set holds all bin minima; an empty bin copies the bin that a universal hash of (bin,
attempt) names first among those filled. Bands of bins are buckets.

In a bucket no pairs are listed. Buckets that share nodes are put into groups round one centre (a star): a bucket's label is its
least node, a node's the least of its buckets' labels, and a bucket joins the group of its nodes' least label. Two nodes of a
bucket are always in one group. Each node of a group is compared with the centre; the links found join components.

Groups that still hold several components are settled by differences. R is the centre's set with every element flipped in
which more than half of the group differ from it, so what a template has in common, and what the centre alone has, counts for
nobody. D(x) = x xor R. Sets x and y are linked exactly if |x xor y| <= (|x| + |y|) q, q = (100 - p) / (100 + p), that is if they
share at least (s(x) + s(y)) / 2 differences, where s(x) = |D(x)| - q |x|. So
* pairs with s(x) + s(y) <= 0 are linked as they are; the node of least s is linked with each node of such a pair, a star again;
* others share differences: those of one node alone count for nothing, the rest are taken rare ones first. The node's entry at a
  place with r behind it helps only partners with s(y) <= 2 (r + 1) - s(x) (the prefix principle), so each entry is dealt to the
  classes of s that it can serve, and meets entries that can serve its own class. Keys within one component are dropped, and so
  are pairs within the group's largest one before they are formed.
No link of a bucket is lost, and copies or templates edited at random share few differences, so the pairs that are left are few.
They are confirmed on the whole sets. With 32 bands of 4 bins a pair at similarity 0.8 shares no bucket with probability 5e-8.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import map_batches, release, stored
from auditlake.llm.components import components
from auditlake.llm.shingles import mix, shared, shingle_sets

BANDS = 32
ROWS = 4
_STEP = np.uint64(0xD1B54A32D192ED03)


@lru_cache(maxsize=64)
def _attempt(bins: int, nth: int) -> np.ndarray:
    """The bin that each empty bin looks at in its nth attempt."""
    return (mix(np.arange(bins, dtype=np.uint64) * _STEP + np.uint64(nth * 0x632BE5AB + 1)) % np.uint64(bins)).astype(np.int64)


@lru_cache(maxsize=4)
def _edges(bins: int) -> np.ndarray:
    return np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)


def one_permutation(values: np.ndarray, bins: int) -> np.ndarray:
    """The least value of each bin; ``values`` are sorted, distinct and not empty, ``bins`` is a power of two."""
    at = np.searchsorted(values, _edges(bins))
    filled = np.diff(at, append=len(values)) > 0
    sketch = values[np.minimum(at, len(values) - 1)]
    empty = np.flatnonzero(~filled)
    nth = 0
    while len(empty):
        look = _attempt(bins, nth)[empty]
        good = filled[look]
        sketch[empty[good]] = sketch[look[good]]
        empty, nth = empty[~good], nth + 1
    return sketch


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for column in sketch.reshape(bands, -1).T:
        keys = mix(keys + column)
    return keys


def node_of(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mix(values + _STEP).sum(dtype=np.uint64), mix(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(values))], "<u8").tobytes()


def _sign(columns: dict, width: int, bands: int, rows: int) -> dict:
    texts = [t or b"" for t in columns["text"].cast(pa.binary()).to_pylist()]
    sets = shingle_sets(texts, width)
    keys = [band_keys(one_permutation(s, bands * rows), bands).view(np.int64) if len(s) else None for s in sets]
    return {**{c: columns[c] for c in ("doc_id", "h", "key")}, "n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets], "bands": keys}


SIGNED = "doc_id long, h long, key string, n_shingles long, node binary, bands array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("key", pa.string()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _confirm(columns: dict, width: int, percent: int, differences: bool) -> dict:
    """Whether each pair of texts reaches the similarity, and what their sets differ in if asked; equal texts are cut once."""
    a, b = columns["a"].to_pylist(), columns["b"].to_pylist()
    texts = dict(zip(a, columns["text_a"].cast(pa.binary()).to_pylist())) | dict(zip(b, columns["text_b"].cast(pa.binary()).to_pylist()))
    sets = dict(zip(texts, shingle_sets(list(texts.values()), width)))
    linked, apart = [], []
    for x, y in zip(a, b):
        both = shared(sets[x], sets[y])
        linked.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
        apart.append(np.setxor1d(sets[x], sets[y], assume_unique=True).view(np.int64) if differences else None)
    return {"a": columns["a"], "b": columns["b"], "linked": linked, "apart": apart}


_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_()), ("apart", pa.list_(pa.int64()))])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, differences: bool = False) -> DataFrame:
    """(a, b, linked, apart) of the pairs (a, b)."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return stored(map_batches(with_both, partial(_confirm, width=width, percent=percent, differences=differences), "a binary, b binary, linked boolean, apart array<long>", _PAIRS))


def _groups(buckets: DataFrame) -> DataFrame:
    """(centre, node, n) of the groups that buckets (bucket, node, n) of several nodes make."""
    full = buckets.groupBy("bucket").agg(F.count("*").alias("held"), F.min("node").alias("label")).where("held > 1").drop("held")
    members = stored(buckets.join(full, "bucket"))
    of_node = members.groupBy("node").agg(F.min("label").alias("least"))
    of_bucket = members.join(of_node, "node").groupBy("bucket").agg(F.min("least").alias("centre"))
    groups = stored(members.join(of_bucket, "bucket").select("centre", "node", "n").distinct())
    release(members)
    return groups


def _class(s: Column, width: Column) -> Column:
    """A rising step function of s: steps of ``width`` below 0, growing ones above."""
    return F.when(s <= 0, F.ceil(s / width)).otherwise(F.ceil(4 * F.log2(1 + F.greatest(s, F.lit(0)) / width))).cast("int")


def _settled(placed: DataFrame, stars: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For groups (centre, node, n, root) of several components and their stars (a, b, linked, apart): (a, b) that are linked by their
    differences alone, and (a, b) that may be linked."""
    up, down = 100 + percent, 100 - percent
    spread = stars.join(placed.select("centre").distinct(), F.col("a") == F.col("centre"), "left_semi")
    apart = spread.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.explode("apart").alias("e"))
    sizes = placed.groupBy("centre").agg(F.count("*").alias("held"), F.max("n").alias("most"))
    roots = placed.groupBy("centre", "root").count().groupBy("centre").agg(F.max_by("root", "count").alias("main"))
    counts = apart.groupBy("centre", "e").agg(F.count("*").alias("c")).join(sizes.select("centre", "held"), "centre")
    flip = 2 * F.col("c") > F.col("held")
    counts = counts.select("centre", "e", flip.alias("flip"), F.when(flip, F.col("held") - F.col("c")).otherwise(F.col("c")).alias("c")).where("flip or c > 1")
    counts = stored(counts)
    flips = counts.where("flip").select("centre", "e", "c")
    marked = stored(apart.join(counts, ["centre", "e"]))
    flipped = flips.groupBy("centre").agg(F.count("*").alias("flips"))
    own = marked.where("flip").groupBy("centre", "node").agg(F.count("*").alias("own"))
    d = spread.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.size("apart").alias("d"))
    whole = placed.join(d, ["centre", "node"], "left").join(own, ["centre", "node"], "left").join(flipped, "centre", "left").na.fill(0, ["d", "own", "flips"])
    s = (F.col("d") - 2 * F.col("own") + F.col("flips")) * up - F.col("n") * down
    whole = whole.join(sizes.select("centre", "most"), "centre").join(roots, "centre").withColumn("s", s)
    whole = stored(whole.select("centre", "node", "n", "root", "main", "s", _class(F.col("s"), F.col("most") * (down / 4)).alias("class"), (F.col("most") * (down / 4)).alias("step")))
    # The node of least s, and all that are linked with it as they are.
    least = whole.groupBy("centre").agg(F.min(F.struct("s", "node", "root")).alias("x")).select("centre", "x.*").withColumnsRenamed({"s": "sx", "node": "a", "root": "ra"})
    at_once = whole.join(least, "centre").where("s + sx <= 0 and root != ra").select("a", F.col("node").alias("b"))
    # What the flipped elements make of nodes that do not differ from the centre there.
    lacking = placed.select("centre", "node").join(flips.where("c > 1"), "centre").join(marked.where("flip").select("centre", "node", "e"), ["centre", "node", "e"], "left_anti")
    shared_ones = marked.where("not flip").select("centre", "node", "e", "c").unionByName(lacking.select("centre", "node", "e", "c"))
    each = Window.partitionBy("centre", "node")
    ranked = shared_ones.withColumn("k", F.row_number().over(each.orderBy("c", "e"))).withColumn("of", F.count("*").over(each))
    entries = ranked.select("centre", "node", "e", (1 + F.col("of") - F.col("k")).alias("rest")).join(whole, ["centre", "node"])
    room = 2 * up * F.col("rest") - F.col("s")
    classes = whole.groupBy("centre").agg(F.collect_set("class").alias("classes"))  # a few dozen at most
    dealt = entries.withColumn("room", room).join(classes, "centre").withColumn("other", F.explode(F.filter("classes", lambda c: c <= _class(F.col("room"), F.col("step")))))
    dealt = dealt.select("centre", "e", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high"), "node", "n", "root", "main", "s", "room", "class")
    dealt = stored(dealt)
    key = ["centre", "e", "low", "high"]
    useful = dealt.groupBy(*key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("r0 != r1 and c0 = low and c1 = high").select(*key)
    useful = dealt.join(useful, key)
    columns = ("node", "n", "root", "s", "room", "class")
    x = useful.where("root != main").select(*key, *[F.col(c).alias(f"{c}_x") for c in columns])
    y = useful.select(*key, (F.col("root") == F.col("main")).alias("inside"), *[F.col(c).alias(f"{c}_y") for c in columns])
    fits = (F.col("room_x") >= F.col("s_y")) & (F.col("room_y") >= F.col("s_x")) & (F.col("s_x") + F.col("s_y") > 0) & _near("n_x", "n_y", percent)
    once = F.col("inside") | (F.col("node_x") < F.col("node_y"))
    both = x.join(y, key).where((F.col("root_x") != F.col("root_y")) & ((F.col("low") == F.col("high")) | (F.col("class_x") != F.col("class_y"))) & once & fits)
    return at_once, both.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _near(n: str, m: str, percent: int) -> Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _roots(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of the linked nodes of groups (centre, node, n)."""
    stars = _confirmed(groups.where("centre != node").select(F.col("centre").alias("a"), F.col("node").alias("b")), texts, width, percent, differences=True)
    first = components(stars.where("linked").select("a", "b"))
    placed = groups.join(first.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("centre", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("centre")
    placed = stored(placed.join(mixed, "centre"))
    if placed.isEmpty():
        return first
    at_once, maybe = _settled(placed, stars, percent)
    links = at_once.union(_confirmed(maybe, texts, width, percent).where("linked").select("a", "b"))
    of = placed.select(F.col("node").alias("x"), "root").distinct()
    links = links.join(of.withColumnRenamed("root", "ra"), F.col("a") == F.col("x")).drop("x").join(of.withColumnRenamed("root", "rb"), F.col("b") == F.col("x"))
    links = stored(links.where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if links.isEmpty():
        return first
    joined = components(links).select(F.col("node").alias("was"), F.col("root").alias("now"))
    # Roots that had no link before are nodes of their own.
    known = first.union(joined.join(first, F.col("was") == F.col("node"), "left_anti").select("was", "was"))
    return stored(known.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")))


def _grouped(docs: DataFrame, key: Column, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, key, n_shingles, node, bands) per row, and (node, root, least, first) per node: its least id, and its least row
    by id, nulls last, text hash and key."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), key.cast("string").alias("key"), text.alias("text"))
    signed = stored(map_batches(source, partial(_sign, width=width, bands=bands, rows=rows), SIGNED, _SIGNED))
    named = stored(signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "key")).alias("first"),
    ))
    groups = _groups(named.select("node", "n", F.explode("bands").alias("bucket")))
    if groups.isEmpty():
        return signed, named.select("node", F.col("node").alias("root"), "least", "first")
    # A centre need not be in its own group.
    needed = groups.select("node").union(groups.select("centre")).distinct()
    wanted = named.join(needed, "node", "left_semi").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.h").alias("h"))
    texts = source.drop("key").join(wanted, source.doc_id.eqNullSafe(wanted.id) & (source.h == wanted.h)).select("node", "text")
    texts = stored(texts.dropDuplicates(["node"]))
    roots = _roots(groups, texts, width, percent)
    return signed, named.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "first")


def later_keys(docs: DataFrame, key: str, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key) of all rows but one for each component: the least by id, nulls last, text hash and key is not given, nor are rows
    without shingles.

    ``key`` names a column of ``docs`` whose values are different in all rows and not null.
    """
    signed, whole = _grouped(docs, F.col(key), width, percent, bands, rows)
    firsts = whole.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.key").alias("kept"))
    of_node = whole.select("node", "root").join(firsts, "root").select("node", "kept")
    return signed.where(F.col("node").isNotNull()).select("node", "key").join(of_node, "node").where("key != kept").select(F.col("key").alias(key))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; see the module for the method.

    A null text or one without words has no shingles, is linked with nothing and is its own component. Rows
    with equal sets are linked, so repeated rows share a component; a repeated id names one document. component_id is the
    smallest id that is not null, or null if there is none; kept says whether the row's id equals it, so all rows of that id
    are kept (``later_keys`` leaves one row). An empty table gives no rows. Other columns are not read.
    """
    signed, whole = _grouped(docs, F.lit(None), width, percent, bands, rows)
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = whole.join(ids, "root").select("node", "component_id")
    done = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
