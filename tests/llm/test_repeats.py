import hashlib
import random

import numpy as np
import pytest

from auditlake.llm.suffix_array import common_prefixes, suffix_order
from auditlake.llm.suffix_dedup import remove_repeats, segments_of_all

NULL = -(1 << 63)


@pytest.mark.parametrize("alphabet", [b"ab", b"abcd\xc3", b"a"])
def test_order_and_common_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 9, 100, 300):
        text = bytes(rng.choice(alphabet) for _ in range(n)) * 2
        order = suffix_order(np.frombuffer(text, np.uint8), 100)
        cut = [text[i : i + 100] for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(text)))
        for enough in (8, 20, 100):
            for i, got in enumerate(common_prefixes(np.frombuffer(text, np.uint8), order, enough), 1):
                a, b = text[order[i - 1] :], text[order[i] :]
                same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got == min(same, enough)


def test_every_window_is_in_one_segment():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 200))) for _ in range(9)]
    of, first, count, _ = segments_of_all(texts, 20, 8)
    got = sorted((d, w) for d, s, n in zip(of.tolist(), first.tolist(), count.tolist()) for w in range(s, s + n))
    assert got == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 19)]


def brute(rows, length):
    """Rows (id, text) in the order of the contract, each with its digest."""
    raw = sorted(((NULL if i is None else i), hashlib.sha256((t or "").encode()).digest(), (t or "").encode()) for i, t in rows)
    seen, out = set(), []
    for i, _, text in raw:
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - length + 1):
            window = text[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((None if i == NULL else i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_edge_rows(edge_docs, edges):
    got = remove_repeats(edge_docs).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(edges, 100)


def test_other_columns_come_along(edge_docs, edges):
    got = remove_repeats(edge_docs).select("doc_id", "row.source", "row.shard").collect()
    assert sorted(r["shard"] for r in got) == sorted(f"shard{k}" for k in range(len(edges)))


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_overlaps_over_many_shards(docs_of, hot):
    rng = random.Random(hot)
    words = [f"{a}{b}{c} " for a in "abc" for b in "xyz" for c in "klm"]
    passages = ["".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages)[rng.randrange(30) : rng.randrange(90, 200)] if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(5)]
        texts.append("".join(parts))
    got = remove_repeats(docs_of(texts), shard_bytes=4096, content_bytes=2048, hot_least=hot).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(list(enumerate(texts)), 100)


def test_no_rows(no_docs):
    assert remove_repeats(no_docs).collect() == []
