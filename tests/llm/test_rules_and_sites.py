import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm.quality_rules import START, LabelModel, default_rules, fit, measures, quality
from auditlake.llm.site_quality import fit as fit_words
from auditlake.llm.site_quality import site_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    hit = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?]?")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_of_edge_rows(edge_docs, edges):
    got = quality(edge_docs).select("doc_id", *BASE, "base_failed").collect()
    want = []
    for i, t in edges:
        m = measured(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_measures_of_random_texts(docs_of):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "\n", "é#| ", "\t", "\x0b", "\x1c", "a b c d e f g h "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    got = {r["doc_id"]: tuple(r)[1:] for r in measures(docs_of(texts)).select("doc_id", *BASE).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_plain_and_distinct_words(docs_of):
    texts = ["plain words, here. it's well-known", "a$ | b!! 12 A-b- x", "über Straße? été! 漢字", "w w W"]
    got = {r["doc_id"]: (r["n_plain"], r["n_distinct"]) for r in measures(docs_of(texts)).collect()}
    assert got == {i: (sum(bool(PLAIN.fullmatch(w)) for w in WORDS.findall(t)), len(set(WORDS.findall(t)))) for i, t in enumerate(texts)}


def test_junk_goes_and_prose_stays(docs_of):
    rng = random.Random(9)

    def prose(n):
        return [rng.choice("bdfgt") + rng.choice("aeiou") + rng.choice(["lan", "ris", "tem"]) + rng.choice("aeiou") + rng.choice("nrs") for _ in range(n)]

    texts, junk = [], set()
    for i in range(400):
        words = prose(rng.randrange(40, 200))
        if i % 10 == 0:
            junk.add(i)
            words = [w + "$$$" for w in words] if i % 20 else [x for w in words for x in (w, "|")]
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["kept"] for r in quality(docs_of(texts)).collect()}
    assert {i for i, k in got.items() if not k} == junk


def test_quality_of_no_rows(no_docs):
    assert quality(no_docs).collect() == []


def test_python_is_not_on_the_path(docs_of):
    plan = measures(docs_of(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def em_by_rows(rows, priors, good, strength, rounds):
    """The same model, row by row in numpy."""
    votes = np.array(rows) + 1
    start = np.array([START] * len(priors))
    share, table = good, start.copy()
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1][votes[:, j]] / table[j, 0][votes[:, j]]) for j in range(len(priors)))
        p = 1 / (1 + np.exp(-odds))
        mass = np.array([strength * (1 - good) + (1 - p).sum(), strength * good + p.sum()])
        for j in range(len(priors)):
            for side, w in ((0, 1 - p), (1, p)):
                table[j, side] = strength * start[j, side] + np.bincount(votes[:, j], w, 3)
                table[j, side] /= table[j, side].sum()
        share = mass[1] / mass.sum()
    return share, table


def test_expectation_maximisation_over_patterns_is_that_over_rows():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.8
    rows = [[int(rng.choice([1 if t else -1, 0, -1 if t else 1], p=[a, 0.1, 0.9 - a])) for a in (0.85, 0.7, 0.6, 0.8)] for t in truth]
    model = fit(list((list(k), n) for k, n in Counter(map(tuple, rows)).items()), 4, rounds=30)
    share, table = em_by_rows(rows, range(4), 0.85, 10.0, 30)
    assert abs(model.good - share) < 1e-6 and np.abs(np.array(model.votes) - table).max() < 1e-6
    found = np.array([model.posterior(r) > 0.5 for r in rows])
    assert (found == truth).mean() > 0.9


def test_model_without_rows_is_the_prior():
    model = fit([], 1)
    assert isinstance(model, LabelModel) and model.good == 0.85 and model.posterior([1]) > model.posterior([0]) > model.posterior([-1])


def test_posterior_column_is_the_models(docs_of):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["word", "OTHER", "a#b$c%", "i"]) for _ in range(rng.randrange(10, 90))) for _ in range(60)]
    rows = quality(docs_of(texts)).collect()
    rules = default_rules()
    model = fit([(list(k), n) for k, n in Counter(tuple(r["votes"]) for r in rows).items()], len(rules))
    for r in rows:
        assert abs(r["quality"] - model.posterior(r["votes"])) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        t = [f"{rng.choice('abcdef')}{rng.choice('xyz')}{rng.randrange(30)}{rng.choice('klm')}o" for _ in range(rng.randrange(20, 200))]
        if bad:
            t = [w + rng.choice(["$$$", "%%%"]) for w in t]
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["nasty", "vile", "awful"])
        texts.append(" ".join(t))
        labels.append((int(not bad), int(toxic)))
    return texts, labels


def test_held_out_accuracy(labelled):
    texts, labels = labelled
    y = np.array(labels, float)
    model = fit_words([t.encode() for t in texts[:600]], y[:600])
    right = (model.log_odds([t.encode() for t in texts[600:]]) > 0) == (y[600:] > 0.5)
    assert right.mean(axis=0).min() > 0.95


def test_sites_shrink_to_the_global_rate(spark, labelled, docs_of):
    texts, labels = labelled
    docs = docs_of(texts).withColumn("source", F.when(F.col("doc_id") < 300, "large").when(F.col("doc_id") == 300, "tiny").otherwise(F.concat(F.lit("s"), F.pmod("doc_id", F.lit(9)))))
    marks = spark.createDataFrame([(i, *q) for i, q in enumerate(labels)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in site_quality(docs, marks, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(rows) == len(texts)
    right = sum((rows[i]["quality"] >= 0.5) == bool(q) for i, (q, _) in enumerate(labels))
    assert right > 0.95 * len(texts)
    # All that a site and path add is one prior per path: the posterior's log-odds less the evidence.
    prior = {i: np.log(r["quality"] / (1 - r["quality"])) - r["quality_evidence"] for i, r in rows.items() if 1e-9 < r["quality"] < 1 - 1e-9}
    large = [p for i, p in prior.items() if i < 300]
    assert max(large) - min(large) < 1e-3
    overall = np.mean([q for q, _ in labels])
    assert abs(1 / (1 + np.exp(-prior[300])) - overall) < 0.1


def test_sites_of_edge_rows(spark, edge_docs, edges, no_docs):
    marks = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (9, 0, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = site_quality(edge_docs, marks, F.col("source"), F.lit(None)).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in edges)
    assert all(0 <= r["quality"] <= 1 and r["kept"] is not None for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality(edge_docs, none, F.col("source"), F.col("lang")).count() == len(edges)
    assert site_quality(no_docs, marks, F.col("source"), F.col("lang")).collect() == []
