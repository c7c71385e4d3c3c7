import random
import re
from collections import defaultdict

import numpy as np
import pytest

from auditlake.llm import near_duplicates as near_duplicates_module
from auditlake.llm.components import components
from auditlake.llm.near_duplicates import near_duplicates, one_permutation
from auditlake.llm.shingles import distinct, mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=4, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(x)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        least = min(ids) if ids else None
        out += [(rows[m][0], len(sets[m]), least, rows[m][0] == least) for m in members]
    return sorted(map(repr, out))


def test_edge_rows(edge_docs, edges):
    assert sorted(repr(tuple(r)) for r in near_duplicates(edge_docs, width=4).collect()) == brute(edges)


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_edited_copies(docs_of, seed):
    """Copies with so many edits that some are linked only through others, and many not at all."""
    rng = random.Random(seed)
    texts = []
    for size in (60, 20, 3):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 140))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(30)}"
            texts.append(" ".join(copy[rng.randrange(6) : len(copy) - rng.randrange(6)]))
    texts += [" ".join(f"n{rng.randrange(10**6)}" for _ in range(80)) for _ in range(20)]
    got = near_duplicates(docs_of(texts), width=4).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(list(enumerate(texts)))


def test_sketch_fills_every_bin():
    for n in (1, 2, 7, 1000):
        values = distinct(mix(np.arange(n, dtype=np.uint64) + np.uint64(99)))
        sketch = one_permutation(values, 128)
        assert len(sketch) == 128 and set(sketch.tolist()) <= set(values.tolist())
        assert sketch.min() == values.min()


def test_sketches_agree_as_often_as_sets(monkeypatch):
    rng, same = np.random.default_rng(0), []
    for _ in range(60):
        a = mix(rng.integers(0, 2**62, 300).astype(np.uint64))
        x, y = distinct(a[:270]), distinct(a[30:])  # 240 of 300
        same.append(np.mean(one_permutation(x, 128) == one_permutation(y, 128)))
    assert abs(np.mean(same) - 0.8) < 0.02


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)} | {500: 500, 501: 500}


def template(rng, common, n, own):
    """Texts on one template, ``own`` words of their own put in anywhere."""
    texts = []
    for _ in range(n):
        words = list(common)
        for _ in range(own):
            words.insert(rng.randrange(len(words)), f"o{rng.randrange(10**9)}")
        texts.append(" ".join(words))
    return texts


def test_unlinked_texts_of_one_template_form_few_pairs(docs_of, monkeypatch):
    rng, compared = random.Random(8), []
    common = [f"c{rng.randrange(10**6)}" for _ in range(150)]
    one = near_duplicates_module._confirmed
    monkeypatch.setattr(near_duplicates_module, "_confirmed", lambda pairs, *a, **k: compared.append(pairs.count()) or one(pairs, *a, **k))
    texts = template(rng, common, 300, 12)
    got = near_duplicates(docs_of(texts), width=4)
    assert got.where("kept").count() == 300
    assert 0 < sum(compared) < 3 * 300


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_of_a_template(docs_of, seed):
    """Two variants of one template with copies at all distances round the bound, sizes that differ, and chains of edits."""
    rng = random.Random(seed)
    common = [f"c{rng.randrange(10**6)}" for _ in range(100)]
    variant = list(common)
    for k in range(30, 36):
        variant[k] = f"v{k}"
    texts = []
    for base in (common, variant, common[:85]):
        for own in (0, 1, 2, 3, 4, 6):
            texts += template(rng, base, 8, own)
    chain = list(common)
    for k in range(12):
        chain[rng.randrange(100)] = f"z{k}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    got = near_duplicates(docs_of(texts), width=4).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(list(enumerate(texts)))
