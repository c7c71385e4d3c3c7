import random

import pytest

CLASHING = ("shard", "bucket", "node", "row", "n", "kept", "root", "sha", "item", "unit", "h", "bands", "key", "id", "rank", "site", "path", "votes")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edge_texts():
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 60)
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "one two"), (8, "Ünï cödé 漢字🙂 " * 30),
        (None, "a row without an id " * 12), (None, None), (9, "same same " * 200), (9, "another text of id nine " * 8), (10, words(rng, 30) + " " + passage + " " + words(rng, 30)),
        (11, passage + " " + words(rng, 50)), (12, "x" * 5000), (13, words(rng, 6000)), (13, words(random.Random(1), 40)), (14, "line one\nline two\nline one\n" * 20),
        (15, "  two  spaces\r\nand <|endoftext|> it's 123  end "), (16, base), (16, base), (17, "ab" * 3000), (-5, words(rng, 100)),
    ]


@pytest.fixture(scope="session")
def edges():
    return edge_texts()


@pytest.fixture(scope="session")
def edge_docs(spark, edges):
    """Null, empty, repeated, tied and very long rows, with extra columns whose names clash."""
    rows = [(i, t, "en", f"src{k % 3}", len(t or "")) + tuple(f"{c}{k}" for c in CLASHING) for k, (i, t) in enumerate(edges)]
    return spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{c} string" for c in CLASHING)).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, start=0):
        return spark.createDataFrame([(start + i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(4)

    return make
