import hashlib
import random
from ast import literal_eval
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from llm.test_near_duplicates import brute as near_brute
from llm.test_rules_and_sites import measured
from llm.test_shards_and_benchmark import split

import corpus_pipeline
from auditlake.llm.common import stored
from auditlake.llm.decontaminate import contamination
from auditlake.llm.quality_rules import quality

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents of every kind, and a benchmark."""
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**4)}" for _ in range(n))

    item, passage = prose(12), prose(60)
    base = prose(90)
    near = base.split()
    near[30] = "edited"
    texts = {
        "clean": prose(80), "short": "too short", "null": None, "repeats": "again and again " * 60, "symbols": " ".join(w + "$%#" for w in prose(50).split()),
        "base": base, "near": " ".join(near), "passage": prose(40) + " " + passage + " " + prose(40), "passage2": prose(50) + " " + passage + " é " + prose(60),
        "leak": prose(50) + " " + item + " " + prose(30), "clean2": prose(200), "clean3": prose(90) + " ünï 漢字",
    }
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", k, len(t or "")) for i, (k, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_one_by_one(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, folder))
        rows = docs.collect()
        left[name] = {texts_key(texts, r["doc_id"]) for r in rows}
        assert len(rows) == len({r["doc_id"] for r in rows}) and {r["doc_id"] for r in rows} <= set(before)
        if name != "pieces":
            assert tuple(docs.columns) == COLUMNS
        if name == "quality_rules":
            for r in rows:
                m = measured(r["text"])
                assert m[0] >= 20 and 100 * m[4] <= 30 * m[0]
        if name == "near_duplicates":
            want = near_brute([(i, r["text"]) for i, r in before.items()], width=5)
            assert len(rows) == sum(x.endswith("True)") for x in want)
        if name == "suffix_dedup":
            seen = set()
            for i, r in sorted(before.items()):
                raw, gone = r["text"].encode(), set()
                for p in range(len(raw) - 99):
                    if raw[p : p + 100] in seen:
                        gone.update(range(p, p + 100))
                    seen.add(raw[p : p + 100])
                kept = bytes(b for p, b in enumerate(raw) if p not in gone).decode("utf-8", "ignore")
                got = next(x for x in rows if x["doc_id"] == i)
                assert got["text"] == kept and got["n_chars"] == len(kept) and got["source"] == r["source"]
        if name == "decontamination":
            item = split(spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"])
            windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
            clean = {i for i, r in before.items() if not any(tuple(split(r["text"])[k : k + 10]) in windows for k in range(len(split(r["text"])) - 9))}
            assert {r["doc_id"] for r in rows} == clean
        if name == "pieces":
            assert all(r["lossless"] for r in rows)
    assert left["pieces"] == {"clean", "base", "passage", "passage2", "clean2", "clean3"}
    assert "symbols" not in left["quality_rules"] and "near" in left["quality_rules"]


def texts_key(texts, doc_id):
    return list(texts)[doc_id]


def test_run_is_all_stages(spark, corpus):
    folder, texts = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {texts_key(texts, r["doc_id"]) for r in rows} == {"clean", "base", "passage", "passage2", "clean2", "clean3"}


def test_edge_rows_and_no_rows(spark, edge_docs, no_docs, corpus):
    folder, _ = corpus
    for docs in (edge_docs.select(*COLUMNS), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, folder))
        assert docs.count() <= edge_docs.count()


def test_rows_of_null_and_repeated_ids_are_judged_one_by_one(spark, edges, corpus):
    """A kept row keeps no other row of its id; of near copies one row stays, whatever their ids."""
    folder, texts = corpus
    base, near, leak = texts["base"], texts["near"], texts["leak"]
    rows = [*edges, (None, texts["clean"]), (None, "too short"), (None, leak), (None, texts["symbols"]), (70, texts["clean2"]), (70, "junk"), (70, leak + " again"), (None, base), (None, near), (None, base), (None, base)]
    rows += [(71, texts["clean3"]), (71, texts["clean3"]), (71, texts["clean3"] + " more"), (None, texts["clean3"])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    # Stage 1: the verdict of each text, from rows with ids of their own.
    alone = docs.select(F.substring("source", 2, 9).cast("long").alias("doc_id"), "text")
    good = {r["doc_id"] for r in quality(alone).where("kept").collect()}
    left = stages["quality_rules"](spark, docs, folder).collect()
    assert {int(r["source"][1:]) for r in left} == good and len(left) == len(good)
    assert any(r["doc_id"] is None for r in left) and not any(r["text"] in (None, "too short", "junk") for r in left)
    # Stage 2: one row of each group, of its least id, nulls last; rows without words stay.
    own = [literal_eval(x) for x in near_brute([(k, t) for k, (_, t) in enumerate(rows)], width=5)]
    groups = defaultdict(list)
    for k, _, least, _ in own:
        groups[least].append(k)
    got = [int(r["source"][1:]) for r in stages["near_duplicates"](spark, docs, folder).collect()]
    assert len(got) == len(set(got)) == len(groups)
    for members in groups.values():
        (one,) = set(members) & set(got)
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        assert rows[one][0] == (min(ids) if ids else None)
    # Stage 4: all rows without a window.
    hit = {r["doc_id"] for r in contamination(alone, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
    got = [int(r["source"][1:]) for r in stages["decontamination"](spark, docs, folder).collect()]
    assert sorted(got) == sorted(set(range(len(rows))) - hit) and len(hit) == 2


def test_suffix_stage_on_edge_rows(spark, edge_docs, edges, corpus):
    """Rows in order of id, nulls first, then of the text's digest; of equal rows the first stands."""
    folder, _ = corpus
    got = dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, edge_docs.select(*COLUMNS), folder).collect()
    seen, want = set(), []
    for i, text in sorted(edges, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want.append((i, bytes(b for p, b in enumerate(raw) if p not in gone).decode("utf-8", "ignore")))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, want))
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" for r in got)


def test_piece_stage_on_edge_rows(spark, edge_docs, edges, corpus):
    folder, _ = corpus
    got = dict(corpus_pipeline.STAGES)["pieces"](spark, edge_docs.select(*COLUMNS), folder).collect()
    model = SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))

    def spelt(ids):
        raw = b"".join(bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i in ids for p in [model.id_to_piece(i)])
        return raw.decode()

    assert sorted(map(repr, ((r["doc_id"], spelt(r["ids"]), r["n_pieces"] == len(r["ids"]), r["lossless"]) for r in got))) == sorted(repr((i, t or "", True, True)) for i, t in edges)


def test_a_stage_deletes_what_the_one_before_stored(spark, corpus, monkeypatch):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stored(stages["near_duplicates"](spark, docs, folder))
    left = [df.stored_at for df in corpus_pipeline._last]
    assert left and all(Path(p.removeprefix("file:")).exists() for p in left[-1:])
    second = stored(stages["decontamination"](spark, first, folder))
    assert not any(Path(p.removeprefix("file:")).exists() for p in left)
    assert second.count() < first.count() <= docs.count()
