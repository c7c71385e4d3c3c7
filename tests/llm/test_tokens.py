import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import units
from auditlake.llm.token_counts import count_in_chunks, token_counts
from auditlake.llm.token_files import pack, token_files, unpack
from auditlake.llm.units import KINDS, UnitCache, ids_of, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", " ", "  ", "\n", "\t", " \n", "'s", "'ll", ".", "#$", "é", "ß", "漢", "🙂", "12", "_", "<|endoftext|>", "<|endof", "text|>", " ", " ", "\x1c", "\x85", "\r\n", "Word", " foo.", " bar,\nBaz", "x" * 70]


def ids(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def mixed(rng, low, high):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(low, high)))


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(units, "MAX_CACHED", 50)
    rng, cache = random.Random(3), UnitCache(PATH, KINDS["H"])
    for _ in range(300):
        texts = [None, "", *(mixed(rng, 0, 40) for _ in range(4)), " ".join(rng.choice(["ab.", "foo", "bar,\nBaz", "it's", "the,"]) for _ in range(9))]
        every, bounds = ids_of(*cache.batch(pa.array(texts, pa.string())), "<u2")
        assert [every[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids(t) for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(100, 40), (400, 100), (64, 64)])
def test_chunks_count_as_whole_texts(chunk, overlap):
    rng = random.Random(chunk)
    texts = [mixed(rng, 200, 900) for _ in range(40)] + ["a" * 900, " " * 700, "a" * 300 + " " * 300 + "b", "", "漢" * 500]
    for text in texts:
        assert count_in_chunks(PATH, text, chunk, overlap) == len(ids(text))


def test_token_counts_of_edge_rows(edge_docs, edges):
    got = token_counts(edge_docs, PATH, chunk=1000, overlap=64).collect()
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in edges]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_token_counts_of_no_rows(no_docs):
    assert token_counts(no_docs, PATH).collect() == []


@pytest.mark.parametrize("n,vocabulary", [(1, 5), (9, 300), (70_001, 50_257), (2_200_000, 90_000)])
def test_files_give_back_their_ids(n, vocabulary):
    every = (np.random.default_rng(n).zipf(1.2, n) % vocabulary).astype(np.uint32)
    keys, sizes, back = unpack(pack([3, None], [every[: n // 2], every[n // 2 :]]))
    assert keys == [3, None] and sizes.tolist() == [n // 2, n - n // 2] and np.array_equal(back, every)


def test_token_files_of_edge_rows(edge_docs, edges):
    got = [tuple(r) for r in token_files(edge_docs, PATH).orderBy("start").collect()]
    each = [(i, len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 0], "<u4").tobytes())) for i, t in edges]
    assert sorted(map(repr, ((i, n, c) for i, _, n, c in got))) == sorted(map(repr, each))
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]
    order = [(-(1 << 63) if i is None else i) for i, *_ in got]
    assert order == sorted(order)


def test_token_files_of_no_rows(no_docs):
    assert token_files(no_docs, PATH).collect() == []


def test_starts_run_over_many_files(docs_of):
    texts = [f"text number {i} " * (i % 7) for i in range(200)]
    got = token_files(docs_of(texts), PATH).orderBy("doc_id").select("doc_id", "start", "n_tokens", F.col("ids_crc32")).collect()
    sizes = [len(ids(t)) + 1 for t in texts]
    assert [r["start"] for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()] and [r["n_tokens"] for r in got] == sizes
