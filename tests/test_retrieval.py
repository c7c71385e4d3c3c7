import random

import numpy as np
import pytest

from auditlake.operators import retrieval

SHAPES = {"few queries": {}, "few documents": {"_small": [False, True]}, "both large": {"_small": [False, False]}}


@pytest.fixture(params=SHAPES)
def shape(request, monkeypatch):
    answers = SHAPES[request.param].get("_small")
    if answers:
        monkeypatch.setattr(retrieval, "_small", lambda *a, it=iter(answers * 50): next(it))
    monkeypatch.setattr(retrieval, "_CELLS", 50)  # several parts per batch


def brute(docs, queries, k):
    out = []
    for qid, text in queries:
        terms = set(text.lower().split())
        scored = [(-len(terms & set(content.lower().split())), ord_) for ord_, content in docs]
        out += [(qid, o, -s, i + 1) for i, (s, o) in enumerate(sorted(x for x in scored if x[0])[:k])]
    return sorted(out)


def test_keyword_topk_is_exact_in_every_shape(spark, shape):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["The", "the,", "É"]
    def sentence():
        return " ".join(rng.choices(words, weights=[9] * 3 + [1] * 30, k=rng.randint(0, 25)))
    docs = [(i * 7 % 101, sentence()) for i in range(101)]
    queries = [(i, sentence()) for i in range(40)]
    d = spark.createDataFrame(docs, "ord long, content string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert sorted(map(tuple, retrieval.keyword_topk(d, q, 4).collect())) == brute(docs, queries, 4)


def test_knn_is_exact_in_every_shape(spark, shape):
    rng = np.random.default_rng(2)
    rows, wanted = rng.normal(size=(83, 8)), rng.normal(size=(9, 8))
    rows[5] = rows[60] * 2  # a tie
    rows[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "ord long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(wanted)], "query_id long, vector array<double>")
    norms = np.linalg.norm(rows, axis=1)
    norms[7] = 1
    cosines = np.round((wanted @ rows.T) / np.linalg.norm(wanted, axis=1)[:, None] / norms, 6)
    expected = [(i, int(j)) for i in range(9) for j in np.lexsort((np.arange(83), -cosines[i]))[:5]]
    hits = retrieval.knn_cosine(v, q, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["ord"]) for r in hits] == expected
    assert all(abs(r["cosine"] - cosines[r["query_id"], r["ord"]]) < 1e-9 for r in hits)


def test_golden_documents(spark):
    docs = spark.createDataFrame(
        [(0, "doc-payments", "payment webhook stripe HMAC signature verification", {"type": "a"}),
         (1, "doc-users", "user authentication JWT token OAuth2", {"type": "b"}),
         (2, "doc-orders", "order management inventory stock", {})],
        "ord long, id string, content string, metadata map<string,string>",
    )
    queries = spark.createDataFrame([(1, "payment stripe webhook"), (2, "quantum physics")], "query_id long, text string")
    hits = retrieval.with_documents(retrieval.keyword_topk(docs, queries, 2), docs).collect()
    assert [(r["query_id"], r["id"], r["overlap"], r["metadata"]) for r in hits] == [(1, "doc-payments", 3, {"type": "a"})]
    assert retrieval.doc_count(docs).first()[0] == 3


def test_first_inserted_wins_ties(spark):
    docs = spark.createDataFrame([(i, f"api endpoint route handler {i}") for i in range(10)], "ord long, content string")
    queries = spark.createDataFrame([(0, "api endpoint route")], "query_id long, text string")
    assert [r["ord"] for r in retrieval.keyword_topk(docs, queries, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_upsert_keeps_the_newest(spark):
    docs = spark.createDataFrame([(1, "a", "old"), (2, "b", "x"), (3, "a", "new")], "ord long, id string, content string")
    assert {(r["id"], r["content"]) for r in retrieval.upsert_documents(docs).collect()} == {("a", "new"), ("b", "x")}


def test_append_keeps_every_copy_in_order(spark, tmp_path):
    path = str(tmp_path / "docs")
    for texts in (["one", "two"], ["three"], ["four", "five"]):
        retrieval.append_documents(spark.createDataFrame([("same", t, {"k": t}) for t in texts], "id string, content string, metadata map<string,string>").coalesce(1), path)
    stored = retrieval.read_documents(spark, path)
    assert [r["content"] for r in stored.orderBy("ord").collect()] == ["one", "two", "three", "four", "five"]
    assert [r["content"] for r in retrieval.upsert_documents(stored).collect()] == ["five"]


def test_nulls_are_left_out_in_every_shape(spark, shape):
    docs = spark.createDataFrame([(0, None), (1, "a b"), (2, "")], "ord long, content string")
    queries = spark.createDataFrame([(0, "a"), (1, None)], "query_id long, text string")
    assert [tuple(r) for r in retrieval.keyword_topk(docs, queries, 2).collect()] == [(0, 1, 1, 1)]
    vectors = spark.createDataFrame([(0, None), (1, [1.0, 0.0]), (2, [1.0, None])], "ord long, vector array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, None)], "query_id long, vector array<double>")
    assert [tuple(r) for r in retrieval.knn_cosine(vectors, asked, 2).collect()] == [(0, 1, 1.0, 1)]


def test_frequent_words_are_counted_in_bounded_slices():
    index = retrieval.TermIndex(retrieval.pa.table({"id": list(range(64)), "words": [["every", "other", f"w{i}"] for i in range(64)]}))
    part = retrieval.pa.RecordBatch.from_pydict({"words": [["every", "other", "w3"], ["none"], ["other"]]})
    whole, cells = index.scores(part), retrieval._CELLS
    try:
        retrieval._CELLS = 40  # fewer than one word's postings
        assert (index.scores(part) == whole).all()
    finally:
        retrieval._CELLS = cells
    assert whole[0, 3] == 3 and whole[0, 4] == 2 and (whole[1] == retrieval._ABSENT).all() and (whole[2] == 1).all()


def test_words_of_many_rows_are_counted_by_matrix():
    rng = random.Random(3)
    rows = [[w for w in ("every", "often", "half") if rng.random() < 0.7] + [f"w{rng.randrange(30)}", "z"][: rng.randrange(3)] for _ in range(200)]
    rows = [list(dict.fromkeys(r)) for r in rows]
    index = retrieval.TermIndex(retrieval.pa.table({"id": list(range(200)), "words": rows}))
    part = retrieval.pa.RecordBatch.from_pydict({"words": rows[:50]})
    assert len(index.dense) >= 3
    want = [[len(set(a) & set(b)) or retrieval._ABSENT for b in rows] for a in rows[:50]]
    assert index.scores(part).tolist() == want


@pytest.mark.parametrize("head", [1, 16, 64, 10_000])
def test_pruned_search_of_two_large_sides_is_exact(spark, monkeypatch, head):
    """Frequent and rare words, ties, queries of frequent words alone, and of words that are nowhere or only in the tail."""
    monkeypatch.setattr(retrieval, "HEAD_ROWS", head)
    rng = random.Random(head)
    common = [f"c{i}" for i in range(12)]

    def some(most):
        return " ".join({*rng.sample(common, rng.randrange(1, 9)), *(f"r{rng.randrange(200)}" for _ in range(rng.randrange(most)))})

    texts = [some(12) + " the" for _ in range(300)] + [None, "", "the", "only here r7"]
    asked = [some(6) + " the" for _ in range(60)] + ["the", "nowhere", None, "the nowhere", "only r7", "r7"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "ord long, content string").repartition(4)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = []
    for q, text in enumerate(asked):
        found = sorted((-len(set((t or "").split()) & set((text or "").split())), 3 * i) for i, t in enumerate(texts))
        want += [(q, o, -n, r + 1) for r, (n, o) in enumerate([f for f in found if f[0]][:4])]
    got = retrieval.keyword_topk(docs, queries, 4, max_rows=0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_word_in_every_text_forms_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HEAD_ROWS", 100)
    docs = spark.createDataFrame([(i, f"the of and w{i} w{i // 2} x{i % 50}") for i in range(3000)], "ord long, content string").repartition(4)
    queries = spark.createDataFrame([(i, f"the of and w{i * 9} x{i % 50}") for i in range(300)], "query_id long, text string")
    pairs, one = [], retrieval._candidates
    monkeypatch.setattr(retrieval, "_candidates", lambda *a: pairs.append(one(*a)) or pairs[-1])
    hits = retrieval.keyword_topk(docs, queries, 3, max_rows=0)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, retrieval.keyword_topk(docs, queries, 3).collect()))
    assert pairs[0].count() < 300 * 80  # of 900,000 that share a word


def test_vectors_of_different_lengths_are_an_error():
    with pytest.raises(ValueError, match="same length"):
        retrieval._unit(retrieval.pa.array([[1.0], [1.0, 2.0]]))


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "ord long, content string")
    queries = spark.createDataFrame([(0, "a b")], "query_id long, text string")
    assert retrieval.keyword_topk(docs, queries).count() == 0
    assert retrieval.keyword_topk(queries.selectExpr("query_id AS ord", "text AS content"), queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        retrieval.keyword_topk(docs, queries, 0)


def test_a_side_of_too_many_rows_is_counted_alone(spark, monkeypatch):
    def measure(df):
        raise AssertionError("its words were worked out to be measured")

    monkeypatch.setattr(retrieval, "measure", measure)
    assert retrieval._size(spark.range(6), 5) == retrieval.Size(6, 0)


def test_null_texts_are_left_out_of_two_large_sides(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "", "b c", "c"])], "ord long, content string")
    queries = docs.withColumnsRenamed({"ord": "query_id", "content": "text"})
    hits = sorted(map(tuple, retrieval.keyword_topk(docs, queries, 1, max_rows=0).collect()))
    assert hits == [(0, 0, 2, 1), (3, 3, 2, 1), (4, 3, 1, 1)]
