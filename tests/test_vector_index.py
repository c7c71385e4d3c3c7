import numpy as np
import pytest

from auditlake.operators import vector_index
from auditlake.operators.retrieval import knn_cosine
from auditlake.operators.vector_index import build_index, k_means, knn_indexed, probes_for


def frame(spark, x, key="ord"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, vector array<double>").repartition(4)


def clustered(n, d=16, centres=20, spread=0.15, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("x", [clustered(1500), np.random.default_rng(1).normal(size=(1500, 24))], ids=["clustered", "even"])
def test_recall_and_exact_search(spark, x):
    vectors = frame(spark, x)
    asked = vectors.where("ord % 20 = 0").withColumnRenamed("ord", "query_id")
    index = build_index(vectors)
    truth = knn_cosine(vectors, asked, 6)
    assert rows(knn_indexed(index, asked, 6, exact=True)) == rows(truth)
    others = lambda hits: {(r["query_id"], r["ord"]) for r in hits.collect() if r["query_id"] != r["ord"]}
    want, got = others(truth), others(knn_indexed(index, asked, 6))
    assert len(want & got) / len(want) >= 0.9


def test_clustered_vectors_ask_few_cells():
    x = clustered(4000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = k_means(x, 100)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1) and probes_for(x, centroids, 0.95, 5) <= 20


def test_a_cell_with_most_vectors_is_cut_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "VECTORS_PER_BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERIES_PER_BLOCK", 7)
    x = np.concatenate([np.tile([1.0, 0.0, 0.0], (300, 1)), np.random.default_rng(2).normal(size=(60, 3))])
    vectors = frame(spark, x)
    asked = vectors.where("ord % 10 = 0").withColumnRenamed("ord", "query_id")
    assert rows(knn_indexed(build_index(vectors), asked, 4, exact=True)) == rows(knn_cosine(vectors, asked, 4))


def test_nulls_zero_vectors_and_few_rows(spark):
    vectors = spark.createDataFrame([(0, None), (1, [1.0, 0.0]), (2, [1.0, None]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.1])], "ord long, vector array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    assert rows(knn_indexed(build_index(vectors), asked, 9, exact=True)) == rows(knn_cosine(vectors, asked, 9))
    assert knn_indexed(build_index(vectors.limit(0)), asked).count() == 0
    assert knn_indexed(build_index(vectors), asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        knn_indexed(None, asked, 0)
