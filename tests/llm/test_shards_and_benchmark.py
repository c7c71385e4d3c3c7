import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.llm.decontaminate import Windows, Words, contamination, words_of
from auditlake.llm.shards import Tree, best_fit, pack, shards


def test_tree_finds_the_least_key_from_on():
    rng, tree, keys = random.Random(1), Tree(), set()
    for _ in range(3000):
        k = (rng.randrange(300), rng.randrange(3))
        if k in keys and rng.random() < 0.6:
            tree.remove(k)
            keys.remove(k)
        elif k not in keys:
            tree.add(k)
            keys.add(k)
        q = (rng.randrange(320), -1)
        assert tree.least_from(q) == min((x for x in keys if x >= q), default=None)
    assert tree.root is None or tree.root[3] <= 14


def test_best_fit_takes_the_tightest_bin():
    assert best_fit([6, 5, 4, 3, 2], 2, 10) == [0, 1, 0, 1, 1]
    assert best_fit([6, 6, 6], 2, 10) is None


def test_pack_is_even_and_gives_giants_their_own_bin():
    rng = random.Random(3)
    items = {i: rng.randrange(1, 1000) for i in range(4000)}
    loads = Counter()
    for i, b in pack(items, 40).items():
        loads[b] += items[i]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) < 0.005 * sum(loads.values()) / 40
    items[-1] = 3 * sum(items.values())
    where = pack(items, 40)
    loads = Counter(where.values())
    assert loads[where[-1]] == 1 and len(loads) == 40
    assert pack({}, 40) == {} and pack({1: 0}, 40) == {1: 0}


def law(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    got = sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows)
    assert got == sorted(repr((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in texts)


def test_shards_of_edge_rows(edge_docs, edges, no_docs):
    rows = shards(edge_docs).collect()
    law(rows, edges)
    of = defaultdict(set)
    for r in rows:
        of[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    assert shards(no_docs).collect() == []


def test_shards_are_even_beside_a_hot_group(docs_of):
    rng = random.Random(6)
    texts = ["the same text " * 5] * 1500 + ["".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(3000)]
    rows = shards(docs_of(texts)).collect()
    law(rows, list(enumerate(texts)))
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    hot = rows[0]["shard"] if rows[0]["doc_id"] < 1500 else next(r["shard"] for r in rows if r["doc_id"] == 0)
    rest = [n for s, n in loads.items() if s != hot]
    assert len(rest) == 39 and max(rest) - min(rest) < 0.03 * max(rest)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def test_words_are_cut_as_the_pattern_does():
    rng = random.Random(4)
    for _ in range(100):
        texts = ["".join(rng.choice(["A", "z", "9", " ", "-", "é", "\x00", "\x7f", "漢", "\n", "_"]) for _ in range(rng.randrange(20))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        made: Words = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert np.diff(made.first_word).tolist() == [len(split(t)) for t in texts]
        assert made.stream[8:-8].tobytes().replace(b"\0", b" ").split() == [w.encode() for t in texts for w in split(t)]


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, "a"), (4, None), (5, ""), (6, "..."), (10, "one two three four five six seven eight nine ten"), (None, "no id"), (7, "漢字 ünï x y z q w e r t y u i o p " * 3)]


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination_of_random_texts(spark, docs_of, edge_docs, edges, block):
    rng = random.Random(block)
    pool = [*(split(ITEMS[0][1])), "short", "item", "a", "b", "漢字", "ünï", "x", "y"]
    texts = []
    for _ in range(150):
        parts = [rng.choice(pool) for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            w = split(rng.choice([ITEMS[0], ITEMS[8]])[1])
            parts += w[rng.randrange(3) : rng.randrange(9, len(w) + 1)]
        texts.append(rng.choice([" ", "-", ", "]).join(parts).title() if rng.random() < 0.3 else " ".join(parts))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    items = [x for x in ITEMS if x[0] is not None]
    got = contamination(docs_of(texts), bench, block_bytes=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(list(enumerate(texts)), items)
    got = contamination(edge_docs, bench, block_bytes=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(edges, items)


def test_empty_tables(spark, no_docs, edge_docs, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).collect() == []
    assert sorted(repr(tuple(r)) for r in contamination(edge_docs, none).collect()) == brute(edges, [])


def test_occurrences_over_piece_borders():
    item = " ".join(f"p{i}q" for i in range(10))
    text = ("z " * 900 + item + " ") * 12 + item
    raw = text.encode()
    made = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    _, word, _ = Windows([("1", item)]).hits(made)
    words = split(text)
    assert sorted(word.tolist()) == [i for i, w in enumerate(words) if w == "p0q"]


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_items_without_an_id_are_searched(spark, docs_of, block):
    bench = spark.createDataFrame([*ITEMS, (None, "lonely passage")], "item_id long, text string")
    texts = ["here is no id at all", "a lonely passage, no id", "clean", "no", "short item lonely passage"]
    rows = {r["doc_id"]: r for r in contamination(docs_of(texts), bench, block_bytes=block).collect()}
    assert [rows[i]["n_hit"] for i in range(5)] == [2, 5, 0, 0, 4]
    assert [rows[i]["contaminated"] for i in range(5)] == [True, True, False, False, True]
    assert [rows[i]["n_items"] for i in range(5)] == [0, 1, 0, 0, 1]
    assert [rows[i]["items_sha256"] for i in range(5)] == [hashlib.sha256(x).hexdigest() for x in (b"", b"3", b"", b"", b"2")]
