import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from auditlake.llm import prefix_trie
from auditlake.llm.prefix_trie import conversation_trie, shared_heads, whole_conversations

SCHEMA = "conv_id long, turn long, role string, text string, id string, parent string, depth string, kids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c - int(c / 5) * 5)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    children = defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
        if node:
            children[node[:-1]] += 1
    rows = []
    for node, who in members.items():
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[node] if x)
        leaves = sum(not children[x] for x in below[node])
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves, saved, sha))
    return sorted(rows, key=repr)


def got(df):
    assert df.dtypes == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]
    return sorted(map(tuple, df.collect()), key=repr)


def many(rng, n, most=12):
    rows, texts = [], ["", "yes", "no", "wörld", None, "a longer text " * 3]
    for c in rng.sample(range(-20, 3 * n), n):
        for turn in range(rng.randint(1, most)):
            # Early turns are shared by many conversations.
            rows.append((c, turn, rng.choice(["user", None]) if turn > 6 else "user", rng.choice(texts[: 1 + min(turn, 5)])))
    return rows


EDGES = [
    (0, 0, "user", "hi"), (0, None, None, None), (0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 1, "assistant", "x"), (1, 5, "user", "hi"),
    (None, 0, "user", "of nobody"), (7, 0, "a", "bc"), (8, 0, "ab", "c"), (9, 0, "", "abc"), (10, 3, "user", "漢字" * 40000), (11, 3, "user", "漢字" * 40000),
    (-3, 0, "user", "hi"), (-5, 0, "user", "below zero"), (14, 0, "user", "t"), (2**62, 0, "user", "far"),
]


def test_edge_rows_as_they_are_and_rebuilt(spark):
    convs = ordered(EDGES)
    assert got(conversation_trie(frame(spark, EDGES))) == brute(convs)
    assert got(conversation_trie(frame(spark, EDGES), shared_heads)) == brute(rebuilt(convs))


def test_no_rows(spark):
    assert conversation_trie(frame(spark, []), shared_heads).collect() == []
    assert conversation_trie(frame(spark, [(None, 0, "user", "x")])).collect() == []


@pytest.mark.parametrize("arrange,of", [(whole_conversations, lambda c: c), (shared_heads, rebuilt)])
def test_many_conversations(spark, arrange, of):
    rows = many(random.Random(5), 120)
    assert got(conversation_trie(frame(spark, rows), arrange)) == brute(of(ordered(rows)))


def test_long_and_nested_conversations(spark, monkeypatch):
    """Chains, prefixes of one another, sums over several blocks, ids over several chunks."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK_BITS", 2)
    line = [("user" if i % 2 else "assistant", f"t{i % 7}") for i in range(90)]
    rows = [(c, i, *line[i]) for c in range(40) for i in range(2 * c + 1)] + [(c, i, *line[i]) for c in range(100, 130) for i in range(60)]
    assert got(conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    turns = []
    one = prefix_trie._round
    monkeypatch.setattr(prefix_trie, "_round", lambda state, turn: turns.append(turn) or one(state, turn))
    n = 3000
    tree = spark.range(n).selectExpr("id", "if(id = 0, null, id - 1) AS parent", "id AS depth", f"if(id = {n - 1}, 0, 1) AS kids", "id AS w")
    totals = {r.id: (r.w, r.l) for r in prefix_trie.subtree_totals(tree).collect()}
    assert len(turns) <= 20
    assert totals == {i: (sum(range(i, n)), 1) for i in range(n)}
