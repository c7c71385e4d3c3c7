"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text's subwords are its byte strings of 2, 3 and 4 within words, a word's edges included; A-Z count in lower case, other
ASCII bytes that are no letters as blanks. Each is hashed to one of ``buckets`` embeddings; a text is the mean of the
embeddings of all its subwords, and a linear layer with softmax tells the language. Both are trained by stochastic gradient
descent in numpy, in one task, on a bounded sample: at most ``max_train`` different texts, as many of each language as there are,
each as a whole and as one short passage, so that short texts are known too. A training example keeps its ``MAX_FEATURES``
most frequent subwords; prediction uses all of every text.

A fifth of the sample is kept from training. On it a temperature is fitted that makes the softmax a probability, and the
least score from which at least ``accuracy`` of the predictions are right; texts below it are ``rejected``.

As the mean and the linear layer commute, prediction adds up one row of ``buckets`` x languages per subword.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import map_batches, small_batches, stored

BUCKETS = 1 << 16
DIM = 16
MAX_TRAIN = 4_000
MAX_FEATURES = 4_096
EPOCHS = 6
BATCH = 32
RATE = 20.0
SHORT_WORDS = 12
UNKNOWN = "und"
_SLICE_CELLS = 4_000_000
_STEP = np.uint32(0x9E3779B1)

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(data: np.ndarray, low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size (places, buckets) of the subwords that start in ``data[low:high]``; data are folded bytes, with 3 blanks behind."""
    bits = np.uint32(32 - buckets.bit_length() + 1)
    window = data[low : high + 3].astype(np.uint32)
    letter = window != 0x20
    n = high - low
    value = window[:n].copy()
    inner = np.ones(n, bool)
    for size in range(2, 5):
        value |= window[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1))
        if size > 2:
            inner &= letter[size - 2 : size - 2 + n]
        at = np.flatnonzero(inner & (letter[:n] | letter[1 : 1 + n]) if size == 2 else inner)
        mixed = (value[at] ^ (value[at] >> np.uint32(15))) * _STEP + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        yield at, ((mixed ^ (mixed >> np.uint32(13))) * _STEP) >> bits


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes of all texts, each between blanks and the last with 3 behind; where each text starts, its blank included)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return _FOLD[np.frombuffer(b"".join(b" " + t for t in texts) + b"   ", np.uint8)], np.cumsum(sizes) - sizes


def features(text: bytes, buckets: int, most: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights that add up to 1) of one text's subwords, the ``most`` frequent ones."""
    data, _ = folded([text])
    counts = np.zeros(buckets, np.int64)
    for low in range(0, len(data) - 3, 1 << 20):
        for _, found in subwords(data, low, min(low + (1 << 20), len(data) - 3), buckets):
            counts += np.bincount(found, minlength=buckets)
    used = np.flatnonzero(counts)
    if len(used) > most:
        used = np.sort(used[np.argsort(-counts[used], kind="stable")[:most]])
    return used.astype(np.int32), (counts[used] / max(1, counts[used].sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """text x language, before the temperature."""
        k = max(1, len(self.langs))
        total, number = np.zeros((len(texts), k)), np.zeros(len(texts))
        if texts and self.langs:
            data, starts = folded(texts)
            step = max(4096, _SLICE_CELLS // k)
            for low in range(0, len(data) - 3, step):
                high = min(low + step, len(data) - 3)
                for at, found in subwords(data, low, high, len(self.scores)):
                    if not len(at):
                        continue
                    text = np.searchsorted(starts, at + low, side="right") - 1
                    first = np.flatnonzero(np.diff(text, prepend=-1))
                    total[text[first]] += np.add.reduceat(self.scores[found], first, axis=0, dtype=np.float64)
                    number[text[first]] += np.diff(first, append=len(at))
        return total / np.maximum(number, 1)[:, None] + (self.bias if self.langs else 0.0)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its probability) of each text."""
        return best(softmax(self.logits(texts) / self.temperature))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = p.argmax(axis=1)
    return at, p[np.arange(len(p)), at]


class Examples:
    """Sparse rows: ids and weights of all, where each begins, and its language's number."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray):
        self.ids = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int32)])
        self.weights = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.float32)])
        self.ends = np.cumsum([len(r[0]) for r in rows], dtype=np.int64)
        self.lang = lang

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], self.ends])[rows]
        sizes = self.ends[rows] - starts
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        return self.ids[at], self.weights[at], first


def train(examples: Examples, langs: int, buckets: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(buckets x langs, bias): embeddings times linear layer, by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(0)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, langs), np.float32), np.zeros(langs, np.float32)
    n, done = len(examples.lang), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            rows = order[low : low + BATCH]
            ids, weights, first = examples.take(rows)
            mean = np.add.reduceat(emb[ids] * weights[:, None], first, axis=0)
            wrong = softmax(mean @ out + bias)
            wrong[np.arange(len(rows)), examples.lang[rows]] -= 1
            step = np.float32(rate * (1 - done / (epochs * n)) / len(rows))
            back = wrong @ out.T
            out -= step / 4 * (mean.T @ wrong)
            bias -= step / 40 * wrong.sum(axis=0)
            for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(ids)])):
                emb[ids[a:b]] -= weights[a:b, None] * (step * back[i])  # an example's ids are distinct
            done += len(rows)
    return emb @ out, bias


def calibrate(logits: np.ndarray, lang: np.ndarray, accuracy: float) -> tuple[float, float]:
    """(temperature, threshold) from rows that were not trained on."""
    if not len(lang):
        return 1.0, 0.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / t)[np.arange(len(lang)), lang], 1e-12)).mean())

    temperature = min(np.geomspace(0.1, 10, 81).tolist(), key=loss)
    at, score = best(softmax(logits / temperature))
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(at[order] == lang[order]) / np.arange(1, len(lang) + 1)
    good = np.flatnonzero(right >= accuracy)
    return temperature, float(score[order[good[-1]]]) if len(good) else 1.0


def fit(rows: list[tuple[str, int, list]], buckets: int, accuracy: float) -> Model:
    """Of (language, hash, examples); every fifth text of a language by hash is kept to calibrate."""
    rows = sorted(rows, key=lambda r: r[:2])
    langs = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(langs)}
    parts: dict[bool, list] = {False: [], True: []}
    for i, (name, _, each) in enumerate(rows):
        parts[i % 5 == 4] += [(x, number[name]) for x in each if len(x[0])]
    own, kept = (Examples([x for x, _ in parts[k]], np.array([y for _, y in parts[k]], np.int64)) for k in (False, True))
    scores, bias = train(own, len(langs), buckets)
    logits = np.zeros((0, len(langs)))
    if len(kept.lang):
        logits = np.add.reduceat(scores[kept.ids] * kept.weights[:, None], kept.ends - np.diff(kept.ends, prepend=0), axis=0, dtype=np.float64) + bias
    temperature, threshold = calibrate(logits, kept.lang, accuracy)
    return Model(langs, scores.astype(np.float32), bias.astype(np.float64), temperature, threshold)


def _examples(columns: dict, buckets: int) -> dict:
    texts = columns["text"].cast(pa.binary()).to_pylist()
    found = {"lang": columns["lang"], "h": columns["h"], "ids": [], "weights": [], "first": []}
    for text, h in zip(texts, columns["h"].to_pylist()):
        words = text.split()
        start = h % max(1, len(words) - SHORT_WORDS + 1)
        parts = [features(text, buckets), features(b" ".join(words[start : start + SHORT_WORDS]), buckets)]
        found["ids"].append(np.concatenate([p[0] for p in parts]))
        found["weights"].append(np.concatenate([p[1] for p in parts]))
        found["first"].append(len(parts[0][0]))
    return found


_EXAMPLES = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32())), ("first", pa.int32())])


def _fit(batches: Iterator[pa.RecordBatch], buckets: int, accuracy: float) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for lang, h, ids, weights, first in zip(*(batch.column(c) for c in ("lang", "h", "ids", "weights", "first"))):
            i, w, k = np.array(ids.values), np.array(weights.values), first.as_py()
            rows.append((lang.as_py(), h.as_py(), [(i[:k], w[:k]), (i[k:], w[k:])]))
    if rows:
        model = fit(rows, buckets, accuracy)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((model.langs, model.scores, model.bias, model.temperature, model.threshold))], pa.binary())})


def _predict(columns: dict, model) -> dict:
    known = model.value
    letters = columns["letters"].to_pylist()
    texts = [t if ok else b"" for t, ok in zip(columns["text"].cast(pa.binary()).to_pylist(), letters)]
    at, score = known.predict(texts)
    names = [known.langs[i] if ok and known.langs else UNKNOWN for i, ok in zip(at.tolist(), letters)]
    sure = [round(float(s), 6) if ok and known.langs else 0.0 for s, ok in zip(score, letters)]
    return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": names, "score": sure, "rejected": [n == UNKNOWN or s < known.threshold for n, s in zip(names, sure)]}


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def train_model(texts: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, accuracy: float = 0.99) -> Model:
    """Fit on (lang, text). The sample is the least by hash of each language's different texts that have a letter, so it does not
    depend on how often a text is repeated or how rows are dealt; the driver gets the model alone."""
    spark = texts.sparkSession
    rows = texts.where(F.col("lang").isNotNull() & _has_letter()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    keys = stored(rows.groupBy("lang", "h").agg(F.lit(0).alias("z")).drop("z"))
    langs = max(1, keys.select("lang").distinct().count())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("h", F.lit(7)), "h")
    chosen = keys.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= max(1, max_train // langs)).drop("k")
    # At most ``max_train`` rows of two short columns (one per language if there are more languages).
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    examples = stored(map_batches(sample.select("lang", "h", "text"), partial(_examples, buckets=buckets), "lang string, h long, ids array<int>, weights array<float>, first int", _EXAMPLES))
    small_batches(spark, rows=64)
    fitted = examples.coalesce(1).mapInArrow(partial(_fit, buckets=buckets, accuracy=accuracy), "model binary").first()
    return Model(*pickle.loads(fitted["model"])) if fitted else Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)


def _has_letter() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row, in one narrow pass; nothing but the text tells the language."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"), _has_letter().alias("letters"))
    done = map_batches(rows, partial(_predict, model=spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", _PREDICTED)
    small_batches(spark, size=2 << 20)
    return done


def in_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text (a null id: of no text) leaves the remainder ``part``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def language_id(docs: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, accuracy: float = 0.99) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row: learned from the text and lang of rows outside the held-out part.

    A null text, and one without a letter, is ``und`` with score 0 and rejected; so is every row if no row has a lang to learn.
    Rows with a null lang are predicted, not learned; an empty lang is a value as any other. Null and repeated ids give a row
    each, repeated rows the same result, learned once. An empty table gives no rows. Other columns are not read.
    """
    held_out = in_held_out(F.col("doc_id"))
    model = train_model(docs.where(~held_out).select("lang", "text"), max_train, buckets, accuracy)
    return predict(docs, model, held_out)
