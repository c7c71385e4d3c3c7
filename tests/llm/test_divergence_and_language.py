import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import language_id as language_module
from auditlake.llm.language_id import calibrate, features, folded, in_held_out, language_id, predict, softmax, subwords, train_model
from auditlake.llm.source_divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least_docs, top):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    rows = []
    for lang in {g for g, _ in counts}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least_docs)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = shares(sum(groups.values(), Counter()))
        of = {s: shares(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            rows += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(whole[t] - of[s][t], t.encode(), t) for t in kept if c[t] and of[s][t] > whole[t]]
            rows += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(rows)


def tagged(spark, docs):
    return spark.createDataFrame([(i, t, g, s, 0, "x", "y") for i, (t, g, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, term string, n string").repartition(6)


def some_docs(n=260):
    rng = random.Random(11)
    vocabulary = ["The", "the", "ÉTÉ", "été", "漢字", "a-b", "x1y", "don't", "🙂", "Zz\x00q", *(f"w{chr(97 + i)}{chr(97 + i // 26)}" for i in range(60))]
    docs = [(" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 30))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b", "É", None, "c"])) for _ in range(n)]
    return docs + [(None, "en", "only nulls"), ("...", "xx", "s"), ("1 2", "xx", "t"), (None, None, ""), ("the " * 50_000, "en", "a"), ("A" * 70_000, "fr", "b")] + [("same row here", "en", "a")] * 40


@pytest.mark.parametrize("options", [{}, {"partial_rows": 5, "cells_per_shard": 20, "sources_per_block": 2}])
def test_divergence_equals_brute_force(spark, options):
    docs = some_docs()
    got = source_divergence(tagged(spark, docs), least_docs=8, top=5, **options)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(docs, 8, 5)


def test_shares_of_huge_counts_are_exact(spark):
    from auditlake.llm.source_divergence import _share

    n, of, v = 987_654_321_987, 9_876_543_219_871, 12_345_678
    assert spark.range(1).select(F.lit(n).alias("n"), F.lit(of).alias("of"), F.lit(v).alias("v")).select(_share("n", "of", "v")).first()[0] == 1 + 10**9 * (n + 5) // (of + 5 * v)


def test_divergence_of_no_rows(no_docs):
    assert source_divergence(no_docs).collect() == []


WORDS = {
    "en": "the and of ing that with this from have which shall house water light".split(),
    "de": "der und die nicht über schön straße haus wasser licht keine einfach".split(),
    "ja": "これ は 水 家 光 です ありがとう 私 行く".split(),
}


def sentences(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[g], k=rng.randint(1, 40))), g) for i, g in enumerate(rng.choices(list(WORDS), weights=[10, 3, 1], k=n))]


def of_rows(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, "1", "2") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, ids string").repartition(4)


EDGES = [
    (None, "the house and the water", "en"), (-1, None, "en"), (-2, "", "de"), (-3, "12 34 ... 🙂 —", "de"), (-4, "und die straße", None), (-5, "THE HOUSE AND THE WATER " * 20_000, "en"),
    (-6, "これは水です", None), (-7, "the\u0000house", "en"), (-7, "the\u0000house", "en"), (-8, "é", ""),
]


def test_language_of_held_out_and_edge_rows(spark):
    rows = sentences(1200) + EDGES
    docs = of_rows(spark, rows)
    got = language_id(docs, buckets=1 << 12).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    want = {i: g for i, _, g in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert len(held) > 200 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.99
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for i in (-1, -2, -3) for r in by_id[i])
    assert [by_id[i][0].lang_pred for i in (None, -4, -5, -6, -7)] == ["en", "de", "en", "ja", "en"]
    assert len(by_id[-7]) == 2 and len(set(by_id[-7])) == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_held_out_is_learned(spark):
    rows = sentences(400)
    docs = of_rows(spark, rows)
    twisted = docs.withColumn("lang", F.when(in_held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    first, second = (sorted(map(tuple, language_id(d, buckets=1 << 10, max_train=300).collect())) for d in (docs, twisted))
    assert first == second


def test_no_language_to_learn(spark, no_docs):
    assert language_id(no_docs).collect() == []
    got = language_id(of_rows(spark, [(1, "text", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}


def test_text_unlike_all_languages_is_rejected_more_often(spark):
    docs = of_rows(spark, sentences(900))
    model = train_model(docs.select("lang", "text"), max_train=600, buckets=1 << 12)
    own = predict(docs, model, F.lit(False)).where("rejected").count() / 900
    other = predict(of_rows(spark, [(i, "".join(random.Random(i).choices("qxzkvjw ", k=30)), None) for i in range(100)]), model, F.lit(False)).where("rejected").count() / 100
    assert own < 0.05 < other


def test_subwords_and_long_texts(spark, monkeypatch):
    """Sums over slices are those of a plain loop, and neighbours in a batch don't matter."""
    model = train_model(of_rows(spark, sentences(200)).select("lang", "text"), max_train=100, buckets=1 << 10)
    texts = ["", "a", "Über straße. 12 zwei", "x " * 30_000, "wörter " * 9_000]

    def plain(text):
        data = bytes(folded([text.encode()])[0][:-3])
        grams = [(data + b" ")[i : i + n] for n in (2, 3, 4) for i in range(len(data) + 2 - n)]
        grams = [g for g in grams if b" " not in g[1:-1] and g.strip()]
        out = np.zeros(len(model.langs))
        cells = {}
        for g in grams:
            if g not in cells:
                by_size = [found for _, found in subwords(np.frombuffer(g + b"   ", np.uint8), 0, 1, 1 << 10)]
                cells[g] = int(by_size[len(g) - 2][0])
            out += model.scores[cells[g]]
        return out / max(1, len(grams)) + model.bias

    monkeypatch.setattr(language_module, "_SLICE_CELLS", 15_000)
    got = model.logits([t.encode() for t in texts])
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)


def test_features_weigh_one_and_calibration_finds_the_threshold():
    ids, weights = features("Straße und Haus".encode(), 1 << 10)
    assert len(set(ids.tolist())) == len(ids) and abs(weights.sum() - 1) < 1e-5
    assert features(b"", 1 << 10)[0].size == 0 and len(features(b" ".join(b"%06x" % (i * 7919) for i in range(9000)), 1 << 16, 50)[0]) == 50
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3)) * 3
    lang = np.array([rng.choice(3, p=p) for p in softmax(logits / 2)])  # too sure by a factor of two
    temperature, threshold = calibrate(logits, lang, 0.85)
    assert 1.7 < temperature < 2.4
    p = softmax(logits / temperature)
    sure = p.max(axis=1) >= threshold
    assert np.mean(p.argmax(axis=1)[sure] == lang[sure]) >= 0.85 and 0.1 < sure.mean() < 0.9
