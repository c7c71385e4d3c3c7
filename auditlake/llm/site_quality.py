"""Quality and toxicity by hierarchical empirical Bayes: a document's own evidence on top of its site's and path's rates.

1. A logistic classifier is fitted on at most MAX_TRAIN labelled rows (by hash of their id) over words, word heads and binned text
   measures. Its log-odds less those of its training rows are a document's evidence.
2. Sites and paths are pooled by grouped aggregation over all documents: a labelled one counts by its label, any other by
   the classifier's probability at SOFT weight. The spread of the sites' rates around the global rate gives the strength
   of the global prior by the method of moments; in the same way the paths' spread around their sites. So a site with few
   documents is drawn to the global rate and a path to its site's.
3. A document's posterior log-odds are those of its path's posterior rate plus its evidence.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import map_batches, small_batches, stored
from auditlake.llm.shingles import OTHERS, mix, word_hashes

MAX_TRAIN = 6_000
BINS = 8
SOFT = 0.1
ROUNDS = 25
RIDGE = 0.3
WORDS = 384
HEADS = (6, 7)  # bytes
LEAST_GAP = 5.0
LEAST_ROWS = 8
TARGETS = ("quality", "toxic")
GROUP_BYTES = 1 << 19
MAX_BROADCAST_PATHS = 200_000
_CLASSES = {"upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "symbol": b"#$%&*<>{}[]\\^~|=+_/@", "mark": b"!?.,;:", "line": b"\n", "bar": b"|", "bang": b"!", "wide": range(0x80, 0x100)}


def _table(which) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(which)] = 1
    return table


def measures(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(one row of measures per text, the distinct hashes of its words and of their heads), by groups of bounded bytes."""
    numbers, distinct, at = [np.zeros((0, len(_CLASSES) + 3))], [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= GROUP_BYTES):
            size += len(texts[stop])
            stop += 1
        some, found = _measures(texts[at:stop])
        numbers.append(some)
        distinct += found
        at = stop
    return np.concatenate(numbers), distinct


def _measures(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes, first, *heads = word_hashes([bytes(t) for t in texts], OTHERS, HEADS)
    words = np.diff(first)
    columns = []
    for which in _CLASSES.values():
        counts = np.concatenate([[0], np.cumsum(_table(which)[data], dtype=np.float64)])
        columns.append((counts[starts + sizes] - counts[starts]) / np.maximum(sizes, 1))
    distinct, varied = [], np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own, at = np.unique(hashes[a:b], return_index=True)
        varied[i] = len(own)
        found = [own]
        for head in heads:  # and what a head has in different words: one, two or four at least
            some, many = np.unique(head[a:b][at], return_counts=True)
            found += [some, mix(some[many >= 2]), mix(some[many >= 4] + np.uint64(1))]
        distinct.append(np.unique(np.concatenate(found)))
    columns += [np.log1p(words), sizes / np.maximum(words, 1), varied / np.maximum(words, 1)]
    return np.stack(columns, axis=1), distinct


@dataclass
class Classifier:
    """Weights of the bins of each measure, then of the words, then the constant; ``base`` are the training rows' log-odds."""

    edges: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all that are set."""
        numbers, words = measures(texts)
        n, k = len(texts), len(self.edges)
        bins = [np.searchsorted(e, numbers[:, i], side="right") + i * (BINS + 1) for i, e in enumerate(self.edges)]
        row = np.repeat(np.arange(n), [len(w) for w in words])
        every = np.concatenate([*words, np.zeros(0, np.uint64)])
        at = np.searchsorted(self.words, every)
        hit = np.append(self.words, np.uint64(0))[at] == every if len(self.words) else np.zeros(len(every), bool)
        return np.concatenate([np.tile(np.arange(n), k), row[hit]]), np.concatenate([*bins, k * (BINS + 1) + at[hit]]).astype(np.int64)

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        row, at = self.features(texts)
        return np.stack([np.bincount(row, w[at], len(texts)) + w[-1] for w in self.weights.T], axis=1)


def fit(texts: list[bytes], labels: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps over the bins and the words that tell most. Of one class, the base alone.

    ``labels``: a row of 0 or 1 per text, a column per target.
    """
    n, k = len(texts), len(_CLASSES) + 3
    rate = (labels.sum(axis=0) + 1) / (n + 2) if n else np.full(len(TARGETS), 0.5)
    base = np.log(rate / (1 - rate))
    model = Classifier(np.zeros((k, BINS)), np.zeros(0, np.uint64), np.zeros((k * (BINS + 1) + 1, len(TARGETS))), base)
    model.weights[-1] = base
    if n < 2:
        return model
    numbers, words = measures(texts)
    model.edges = np.quantile(numbers, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    row = np.repeat(np.arange(n), [len(w) for w in words])
    every, at, seen = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    told = []
    for y in labels.T:
        ones = y.sum()
        if 0 < ones < n:  # the words whose share differs most between the classes
            among, share = np.bincount(at, y[row], len(every)), seen / n
            gap = np.abs(among / ones - (seen - among) / (n - ones)) / np.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)) + 1e-12)
            gap[seen < LEAST_ROWS] = 0
            best = np.argsort(-gap, kind="stable")[:WORDS]
            told.append(every[best[gap[best] > LEAST_GAP]])
    model.words = np.unique(np.concatenate([*told, np.zeros(0, np.uint64)]))
    model.weights = np.zeros((k * (BINS + 1) + len(model.words) + 1, len(TARGETS)))
    model.weights[-1] = base
    row, at = model.features(texts)
    x = np.zeros((n, len(model.weights)))
    x[row, at] = 1
    x[:, -1] = 1
    ridge = np.full(len(model.weights), RIDGE)
    ridge[-1] = 1e-6
    for t, y in enumerate(labels.T):
        if not 0 < y.sum() < n:
            continue
        w = model.weights[:, t].copy()

        def loss(w: np.ndarray, y=y) -> float:
            z = x @ w
            return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2)

        now = loss(w)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
            step = 1.0
            while step > 1e-6 and loss(w - step * change) > now:  # Newton steps may go too far where classes are apart
                step /= 2
            w -= step * change
            before, now = now, loss(w)
            if before - now < 1e-6 * max(1.0, abs(now)):
                break
        model.weights[:, t] = w
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [t or b"" for t in batch.column("text").to_pylist()]
        labels += zip(*(batch.column(t).to_pylist() for t in TARGETS))
    model = fit(texts, (np.array(labels).reshape(-1, len(TARGETS)) >= 0.5).astype(float))
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((model.edges, model.words, model.weights, model.base))], pa.binary())})


def _score(columns: dict, model) -> dict:
    odds = model.value.log_odds([t or b"" for t in columns["text"].cast(pa.binary()).to_pylist()])
    evidence = odds - model.value.base
    return {**{c: columns[c] for c in ("doc_id", "site", "path")}, "quality_evidence": evidence[:, 0], "toxic_evidence": evidence[:, 1]}


_SCORED = pa.schema([("doc_id", pa.int64()), ("site", pa.string()), ("path", pa.string()), ("quality_evidence", pa.float64()), ("toxic_evidence", pa.float64())])
SCORED = "doc_id long, site string, path string, quality_evidence double, toxic_evidence double"


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength in rows by the method of moments: how much the groups' rates vary beyond chance around ``mean``."""
    g = groups.where(F.col("n") > 0)
    off = F.col("s") / F.col("n") - mean
    stats = g.agg(F.sum(F.col("n") * off * off).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col("n") * mean * (1 - mean)).alias("full")).first()
    if not stats["full"] or stats["spread"] is None:
        return 100.0
    excess = stats["spread"] - stats["chance"]  # expected: share of variance between groups, times ``full``
    rho = max(excess / stats["full"], 1e-4)
    return min(max(1 / rho - 1, 1.0), 10_000.0)


def site_quality(docs: DataFrame, labels: DataFrame, site: Column, path: Column, max_train: int = MAX_TRAIN, threshold: float = 0.5, toxic_threshold: float = 0.3) -> DataFrame:
    """(doc_id, site, path, quality_evidence, toxic_evidence, quality, toxicity, kept) per row; see the module.

    A null text is empty, a null site or path the empty one. Rows keep null and repeated ids; a document with several labels
    counts by their mean, a null label not at all. Without labels all rates are a half. ``kept``: the posterior
    of quality reaches ``threshold`` and that of toxicity stays below ``toxic_threshold``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in TARGETS])
    known = stored(known)
    small_batches(spark)
    train = known.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(train), "doc_id")
    # A repeated id must not bring more rows than the bound.
    rows = chosen.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_train).select(F.col("text").cast("binary").alias("text"), *TARGETS)
    fitted = rows.coalesce(1).mapInArrow(_fit, "model binary").first()  # in a task: the driver gets the weights alone
    model = Classifier(*pickle.loads(fitted["model"])) if fitted else fit([], np.zeros((0, len(TARGETS))))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), text.alias("text"))
    scored = stored(map_batches(source, partial(_score, model=spark.sparkContext.broadcast(model)), SCORED, _SCORED))
    counted = scored.join(known, "doc_id", "left")
    parts = []
    for i, t in enumerate(TARGETS):
        weight = F.when(F.col(t).isNotNull(), 1.0).otherwise(SOFT)
        value = F.coalesce(F.col(t), _sigmoid(F.col(f"{t}_evidence") + float(model.base[i])))
        parts += [F.sum(weight).alias(f"n_{t}"), F.sum(weight * value).alias(f"s_{t}")]
    paths = stored(counted.groupBy("site", "path").agg(*parts))
    sites = paths.groupBy("site").agg(*[F.sum(f"{k}_{t}").alias(f"{k}_{t}") for t in TARGETS for k in "ns"])
    whole = sites.agg(*[F.sum(f"{k}_{t}").alias(f"{k}_{t}") for t in TARGETS for k in "ns"]).first()
    for t in TARGETS:
        overall = F.lit(((whole[f"s_{t}"] or 0.0) + 0.5) / ((whole[f"n_{t}"] or 0.0) + 1.0))
        held = _strength(sites.select(F.col(f"n_{t}").alias("n"), F.col(f"s_{t}").alias("s")), overall)
        sites = sites.withColumn(f"site_{t}", (F.col(f"s_{t}") + held * overall) / (F.col(f"n_{t}") + held))
    rates = stored(paths.join(sites.select("site", *[f"site_{t}" for t in TARGETS]), "site"))
    for t in TARGETS:
        held = _strength(rates.select(F.col(f"n_{t}").alias("n"), F.col(f"s_{t}").alias("s"), F.col(f"site_{t}").alias("m")), F.col("m"))
        rates = rates.withColumn(f"path_{t}", (F.col(f"s_{t}") + held * F.col(f"site_{t}")) / (F.col(f"n_{t}") + held))
    rates = rates.select("site", "path", *[f"path_{t}" for t in TARGETS])
    if rates.count() <= MAX_BROADCAST_PATHS:
        rates = F.broadcast(rates)
    joined = scored.join(rates, ["site", "path"])
    done = joined.select(
        "doc_id", "site", "path", "quality_evidence", "toxic_evidence",
        _sigmoid(_logit(F.col("path_quality")) + F.col("quality_evidence")).alias("quality"), _sigmoid(_logit(F.col("path_toxic")) + F.col("toxic_evidence")).alias("toxicity"),
    )
    return done.withColumn("kept", (F.col("quality") >= threshold) & (F.col("toxicity") < toxic_threshold))
