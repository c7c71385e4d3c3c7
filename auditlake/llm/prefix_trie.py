"""The prefix trie of conversations, its subtree totals by parallel tree contraction.

A conversation is its turns (role, text) in order; a node of depth d is a distinct sequence of first d turns.

*Order.* Turns are range-partitioned and sorted once; a turn's place is its row's number in the partition plus what earlier
partitions hold of the conversation, so a conversation of any length is spread over many tasks. Texts are left behind there:
from then on a turn is a pair of hashes.

*Nodes.* Each (depth, turn) is hashed to two numbers of LANE_BITS bits, and a prefix is named by their running sums. Sums are
taken in blocks of BLOCK turns, each started with the totals of the blocks before it.

*Contraction.* Every round rakes all leaves into their parents, then compresses unary chains: a node with one child and a
parent is taken out if its coin shows heads and its parent's tails, so no two neighbours go at once, and its weight moves
to the edge above its child. Coins are bits of the depth, which halve a chain, and in every third round a hash of the node,
so that chains that form later shrink as well. What is left is a constant share each round, and the root at the end. A raked
leaf's total is known when it goes. Going back round by round, a compressed node's total is its child's, plus the edge
between them, plus its own weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import release, small_batches, stored

LANE_BITS = 50
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
IDS_PER_CHUNK_BITS = 16
_MASK = (1 << LANE_BITS) - 1


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, row, t1, t2, n_bytes) per turn, rows numbered in order, and (conv_id, part, first, before, n): what each
    partition holds of a conversation, its first row and how many turns earlier partitions hold.

    Turns of one number go by role, then text. A null role or text is empty, a null turn comes first; rows without a conv_id
    belong to no conversation.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Range keys are sampled by the driver, so they hold the head of a text alone; the order is the same.
    spread = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64))
    turns = spread.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"),
    )
    turns = stored(turns)
    held = turns.groupBy("conv_id", _part()).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, stored(held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def _part() -> Column:
    return F.shiftright("row", 33).alias("part")


def whole_conversations(turns: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, n_bytes, last) per turn, and (conv_id, length) per conversation, as they are."""
    lengths = held.groupBy("conv_id").agg(F.sum("n").alias("length"))
    placed = turns.withColumn("part", _part()).join(held.join(lengths, "conv_id"), ["conv_id", "part"])
    depth = F.col("row") - F.col("first") + F.col("before") + 1
    return placed.select("conv_id", depth.alias("depth"), "t1", "t2", "n_bytes", (depth == F.col("length")).alias("last")), lengths


def shared_heads(turns: DataFrame, held: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The same for conversations rebuilt with the head of another one.

    Conversation c starts with the first h turns of conversation c - c % every (all if it has fewer, none if there is no
    such), and goes on with its own turns after its first h; h = crc32(decimal c) % heads. A conversation may be left without
    turns.
    """
    c = F.col("conv_id")
    own = held.groupBy("conv_id").agg(F.sum("n").alias("own"))
    bases = own.select(c.alias("base"), F.col("own").alias("of_base"))
    asked = own.withColumns({"base": c - c % every, "h": F.crc32(c.cast("string").cast("binary")) % heads}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("of_base", F.lit(0)))
    plans = stored(asked.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    place = (F.col("row") - F.col("first") + F.col("before")).alias("place")
    placed = stored(turns.withColumn("part", _part()).join(held.join(plans, "conv_id"), ["conv_id", "part"]).select("conv_id", place, "t1", "t2", "n_bytes", "h", "taken", "length"))
    depth = F.col("place") - F.col("h") + F.col("taken") + 1
    rest = placed.where("place >= h").select("conv_id", depth.alias("depth"), "t1", "t2", "n_bytes", (depth == F.col("length")).alias("last"))
    # A head has fewer than ``heads`` turns and is asked for by ``every`` conversations, so this join stays small per key.
    given = placed.where((F.col("place") < heads) & (c % every == 0)).select(c.alias("base"), "place", "t1", "t2", "n_bytes")
    lent = given.join(plans, "base").where("place < h")
    first = lent.select("conv_id", (F.col("place") + 1).alias("depth"), "t1", "t2", "n_bytes", (F.col("place") + 1 == F.col("length")).alias("last"))
    return rest.unionByName(first), plans.select("conv_id", "length")


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, n_bytes, last): for each turn, and for the root, the node and its parent."""
    mask = F.lit(_MASK)
    block = F.shiftright("depth", BLOCK_BITS).alias("block")
    lanes = turns.select("conv_id", "depth", block, "n_bytes", "last", *[F.xxhash64("depth", f"t{j}").bitwiseAND(mask).alias(f"l{j}") for j in (1, 2)])
    lanes = stored(lanes)
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = lanes.withColumns({f"s{j}": F.sum(f"l{j}").over(so_far) for j in (1, 2)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = lanes.groupBy("conv_id", "block").agg(*[F.sum(f"l{j}").cast("decimal(38,0)").alias(f"b{j}") for j in (1, 2)])
    before = totals.select("conv_id", "block", *[(F.sum(f"b{j}").over(earlier) % F.lit(1 << LANE_BITS).cast("decimal(38,0)")).cast("long").alias(f"o{j}") for j in (1, 2)])
    whole = inside.join(before.where("o1 is not null"), ["conv_id", "block"], "left")
    named = whole.withColumns({f"n{j}": (F.col(f"s{j}") + F.coalesce(f"o{j}", F.lit(0))).bitwiseAND(mask) for j in (1, 2)})
    below = named.select("conv_id", "depth", "n1", "n2", *[(F.col(f"n{j}") - F.col(f"l{j}")).bitwiseAND(mask).alias(f"p{j}") for j in (1, 2)], "n_bytes", "last")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), none.alias("p1"), none.alias("p2"), zero.alias("n_bytes"), (F.col("length") == 0).alias("last"))
    return below.unionByName(root)


_HASHED = pa.schema([("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of chunks (n1, n2, ids); a run may go on over many batches."""
    key, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for n1, n2, ids in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "ids"))):
            if (n1, n2) == key:
                state.update(b",")
            else:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (n1, n2), hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(_HASHED)], schema=_HASHED)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, state.hexdigest()), _HASHED)], schema=_HASHED)


def _ends(members: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) of each node where conversations end. Ids are joined by range of ids, at most 2 ** IDS_PER_CHUNK_BITS
    at once; the task of a node reads these chunks one after another and holds no more than a batch."""
    last = members.where("last").withColumn("chunk", F.shiftright("conv_id", IDS_PER_CHUNK_BITS))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = last.groupBy("n1", "n2", "chunk").agg(ids.alias("ids"))
    small_batches(members.sparkSession)
    return chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "chunk").select("n1", "n2", "ids").mapInArrow(_hash_chunks, "e1 long, e2 long, ends_sha256 string")


def _coin(node: str, depth: str, turn: int) -> Column:
    if turn % 3 == 2:
        return F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1
    return F.shiftright(depth, (turn - turn // 3) % 40).bitwiseAND(F.lit(1)) == 1


_STATE = ("id", "parent", "depth", "above", "kids", "w", "l", "ew", "el")


def _round(state: DataFrame, turn: int) -> DataFrame:
    """Rake, then compress. Besides the new state: ``gone`` for nodes taken out, and on their child's row the node (u) and what its
    total has beyond the child's (uw, ul)."""
    leaf = F.col("kids") == 0
    raked = state.where("parent is not null").groupBy(F.col("parent").alias("g")).agg(
        F.sum(F.when(leaf, F.col("w") + F.col("ew")).otherwise(0)).alias("gw"), F.sum(F.when(leaf, F.col("l") + F.col("el")).otherwise(0)).alias("gl"),
        F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("id"))).alias("only"),
    )
    inner = state.where(~leaf).join(raked, F.col("id") == F.col("g"))
    inner = inner.select("id", "parent", "depth", "above", F.col("left").alias("kids"), (F.col("w") + F.col("gw")).alias("w"), (F.col("l") + F.col("gl")).alias("l"), "ew", "el", "only")
    out = F.col("parent").isNotNull() & (F.col("kids") == 1) & _coin("id", "depth", turn) & ~_coin("parent", "above", turn)
    inner = inner.withColumn("gone", F.coalesce(out, F.lit(False)))
    taken = inner.where("gone").select(F.col("only").alias("x"), F.col("id").alias("u"), F.col("parent").alias("up"), F.col("above").alias("far"), *[F.col(c).alias(f"x_{c}") for c in ("w", "l", "ew", "el")])
    joined = inner.join(taken, F.col("id") == F.col("x"), "left")
    more = {c: F.coalesce(F.col(f"x_{c}") + F.col(f"x_e{c}"), F.lit(0)) for c in "wl"}
    return joined.select(
        "id", F.coalesce("up", "parent").alias("parent"), "depth", F.coalesce("far", "above").alias("above"), "kids", "w", "l",
        (F.col("ew") + more["w"]).alias("ew"), (F.col("el") + more["l"]).alias("el"), "gone", "u", (F.col("x_w") + F.col("ew")).alias("uw"), (F.col("x_l") + F.col("el")).alias("ul"),
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(id, w, l) summed over each node's subtree: ``w`` and the leaves. ``tree``: (id, parent, depth, kids, w), one or more roots
    with a null parent; ids are unique, ``kids`` counts a node's children."""
    one = F.when(F.col("kids") == 0, 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    state = stored(tree.select("id", "parent", "depth", (F.col("depth") - 1).alias("above"), F.col("kids").cast("long").alias("kids"), "w", one.alias("l"), zero.alias("ew"), zero.alias("el")))
    rounds = [state]
    while not state.where("parent is not null").isEmpty():
        rounds.append(stored(_round(state, len(rounds) - 1)))
        state = rounds[-1].where("not gone").select(*_STATE)
    known = state.select("id", "w", "l")
    kept: list[DataFrame] = []
    for turn in range(len(rounds) - 1, -1, -1):
        if turn < len(rounds) - 1:
            leaves = rounds[turn].where("kids = 0 and parent is not null" + (" and not gone" if turn else ""))
            known = known.union(leaves.select("id", "w", "l"))
        if turn:
            kept.append(known := stored(known) if turn < len(rounds) - 1 else known)
            back = rounds[turn].where("u is not null").select(F.col("u"), F.col("id").alias("x"), "uw", "ul")
            known = known.union(back.join(known, F.col("x") == F.col("id")).select("u", F.col("w") + F.col("uw"), F.col("l") + F.col("ul")))
    known = stored(known)
    release(*rounds, *kept)
    return known


def conversation_trie(conversations: DataFrame, arrange=whole_conversations) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node; see the module.

    conv_id is the smallest id of the node's conversations, so (conv_id, depth) names it, and parent_conv_id that of its
    parent (null for the root); n_convs its conversations; n_leaves the nodes without children in its subtree, itself included;
    saved_tokens the sum over its subtree of each node's (n_convs - 1) times the UTF-8 bytes of its last text; ends_sha256 the
    hash of the ids that end there, ascending and joined by commas. ``arrange`` may rebuild the ordered turns (``shared_heads``).

    Nulls, ties and rows without an id: see ``ordered_turns``; repeated rows are turns of their own. Empty texts have no bytes.
    An empty table has no node, not even a root. Other columns are not read.
    """
    turns, held = ordered_turns(conversations)
    members = stored(_prefixes(*arrange(turns, held)))
    found = members.groupBy("n1", "n2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
    )
    found = stored(found.withColumn("id", F.monotonically_increasing_id()))
    # A root of very many children is one key here; the larger side is split at run time, as the rows are written right away.
    parents = found.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(found.join(parents, ["p1", "p2"], "left").select("id", "parent", "n1", "n2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("g")).agg(F.count("*").alias("n_children"))
    tree = stored(nodes.join(children, F.col("id") == F.col("g"), "left").select("id", "parent", "depth", F.coalesce("n_children", F.lit(0)).alias("kids"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("w")))
    totals = subtree_totals(tree).select("id", F.col("w").alias("saved_tokens"), F.col("l").alias("n_leaves"))
    ends = _ends(members)
    whole = nodes.join(tree.select("id", F.col("kids").alias("n_children")), "id").join(totals, "id").join(ends, (F.col("n1") == F.col("e1")) & (F.col("n2") == F.col("e2")), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
