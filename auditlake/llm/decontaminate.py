"""Benchmark decontamination: a Wu-Manber search of all benchmark windows in every document.

Texts become words joined by single spaces, so a window of words is a byte string with a space at both ends. Patterns are
searched in classes of similar length. In a class of least length m the text is read through a block of the last bytes of
an m-byte view: a hashed shift table says how far the view may move without passing an occurrence; at shift 0 the
bucket of the block's hash names the patterns to try, their first bytes select, and a direct comparison confirms.
The views of thousands of text pieces move in step, so every step is a few numpy operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import map_batches, stored

WINDOW = 10
PIECE = 2048
MAX_BLOCK_BYTES = 16 << 20
_PAD = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = (1 << 30, 64, 32, 16, 8, 4, 3)


def _byte_table() -> np.ndarray:
    """Lower case for A-Z, itself for other bytes of words, a space for all else."""
    table = np.full(256, 32, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


BYTES = _byte_table()


@dataclass
class Words:
    """The words of several texts in one stream: after padding, each text is " w1 w2 ... " and a zero byte."""

    stream: np.ndarray
    n_texts: int

    @cached_property
    def starts(self) -> np.ndarray:
        """Where words start in the stream."""
        s = self.stream
        return np.flatnonzero((s[1:] > 32) & (s[:-1] == 32)) + 1

    @cached_property
    def first_word(self) -> np.ndarray:
        """For each text and the end the number of words before it."""
        ends = np.flatnonzero(self.stream[_PAD:] == 0)[: self.n_texts] + _PAD
        return np.concatenate([[0], np.searchsorted(self.starts, ends)])


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``data`` holds the texts' bytes one behind another, text i from offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    spread = np.full(int(offsets[-1] - offsets[0]) + 3 * n, 32, np.uint8)
    spread[np.arange(len(spread) - 3 * n) + np.repeat(3 * np.arange(n) + 1, sizes)] = BYTES[data[offsets[0] : offsets[-1]]]
    spread[np.cumsum(sizes + 3) - 1] = 0
    keep = spread != 32
    keep[1:] |= spread[:-1] != 32
    keep[:1] = True
    return Words(np.concatenate([np.zeros(_PAD, np.uint8), spread[keep], np.zeros(_PAD, np.uint8)]), n)


def arrow_words(texts: pa.Array) -> Words:
    raw = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    return words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))


class WuManber:
    """Patterns of at least ``m`` bytes, each searched by its first m."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.patterns, self.numbers = patterns, numbers
        self.m = min(map(len, patterns))
        self.block = 8 if self.m >= 16 else max(1, self.m // 2)
        self.bits = max(12, min(22, (len(patterns) * self.m).bit_length() + 3))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        head = np.frombuffer(b"".join(b"\0" * _PAD + p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), -1)
        for end in range(self.block, self.m + 1):
            hashes = self._hash(np.ascontiguousarray(head[:, end : end + _PAD]).view("<u8")[:, 0])
            np.minimum.at(self.shift, hashes, self.m - end)
        order = np.argsort(hashes, kind="stable")
        self.by_bucket = order
        self.bucket = np.searchsorted(hashes[order], np.arange((1 << self.bits) + 1))
        self.first = np.array([int.from_bytes(p[:8].ljust(8, b"\0"), "little") for p in patterns], np.uint64)
        self.first_mask = np.uint64((1 << 8 * min(8, self.m)) - 1)
        self.first &= self.first_mask

    def _hash(self, view: np.ndarray) -> np.ndarray:
        """Of the last ``block`` of the 8 bytes in each little-endian number."""
        return (((view >> np.uint64(64 - 8 * self.block)) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in the stream, pattern's number) of every occurrence."""
        size = len(stream) - _PAD  # the end is padded as well
        view = np.ndarray((len(stream) - 7,), "<u8", stream.data, strides=(1,))
        pieces = np.arange(_PAD, size, PIECE, dtype=np.int64)
        last = np.minimum(pieces + PIECE, size) + self.m - 1  # a view that starts in the piece ends before this
        last = np.minimum(last, size)
        at = pieces + self.m - 1
        ends, buckets = [], []
        while len(at):
            alive = at < last
            at, last = at[alive], last[alive]
            hashes = self._hash(view[at - 7])
            step = self.shift[hashes]
            zero = step == 0
            ends.append(at[zero])
            buckets.append(hashes[zero])
            at = at + np.maximum(step, 1)
        end, hashes = np.concatenate([*ends, np.zeros(0, np.int64)]), np.concatenate([*buckets, np.zeros(0, np.int64)])
        start = end - self.m + 1
        tries = self.bucket[hashes + 1] - self.bucket[hashes]
        where = np.repeat(np.arange(len(start)), tries)
        nth = np.arange(len(where)) - np.repeat(np.cumsum(tries) - tries, tries)
        pattern = self.by_bucket[self.bucket[hashes[where]] + nth]
        same = (view[start[where]] & self.first_mask) == self.first[pattern]
        where, pattern = start[where[same]], pattern[same]
        raw, texts = stream.data, self.patterns
        exact = np.fromiter((raw[s : s + len(texts[p])] == texts[p] for s, p in zip(where.tolist(), pattern.tolist())), bool, len(where))
        return where[exact], np.array(self.numbers, np.int64)[pattern[exact]]


class Windows:
    """All windows of the benchmark's items, and the items of each; an item without an id has windows, but no name."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        found: dict[bytes, set[str]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = words_of(raw, np.array([0, len(raw)])).stream.tobytes()[_PAD:-_PAD].rstrip(b"\0").split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                named = found.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set())
                if item is not None:
                    named.add(item)
        self.patterns = sorted(found)
        self.items = [sorted(found[p]) for p in self.patterns]
        self.n_words = np.array([p.count(b" ") - 1 for p in self.patterns], np.int64)
        self.searches = []
        for high, low in zip(_CLASSES, (*_CLASSES[1:], 0)):
            some = [i for i, p in enumerate(self.patterns) if low <= len(p) < high]
            if some:
                self.searches.append(WuManber([self.patterns[i] for i in some], some))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word within all texts, pattern) of every occurrence."""
        found = [s.search(words.stream) for s in self.searches]
        start = np.concatenate([*(f[0] for f in found), np.zeros(0, np.int64)])
        pattern = np.concatenate([*(f[1] for f in found), np.zeros(0, np.int64)])
        word = np.searchsorted(words.starts, start)
        return np.searchsorted(words.first_word, word, side="right") - 1, word, pattern


def _spans(columns: dict, windows: Windows) -> dict:
    """Per text its words, its hit words as maximal runs, and the items that occur."""
    words = arrow_words(columns["text"])
    text, word, pattern = windows.hits(words)
    order = np.argsort(word, kind="stable")
    text, word, pattern = text[order], word[order], pattern[order]
    first = words.first_word
    n = words.n_texts
    bounds = np.searchsorted(text, np.arange(n + 1))
    starts, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    for t in np.flatnonzero(np.diff(bounds)):
        some = slice(bounds[t], bounds[t + 1])
        s = word[some] - first[t]
        e = np.maximum.accumulate(s + windows.n_words[pattern[some]])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        starts[t], ends[t] = s[new].tolist(), e[np.concatenate([new[1:], [True]])].tolist()
        items[t] = sorted({i for p in set(pattern[some].tolist()) for i in windows.items[p]})
    return {**{k: columns[k] for k in ("row", "doc_id", "key")}, "n_words": np.diff(first), "starts": starts, "ends": ends, "items": items}


SPANS = "row long, doc_id long, key string, n_words long, starts array<long>, ends array<long>, items array<string>"
_LONGS = pa.list_(pa.int64())
_FIELDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()), ("starts", _LONGS), ("ends", _LONGS), ("items", pa.list_(pa.string()))])


def _merge(columns: dict) -> dict:
    starts, ends = [], []
    for s, e in zip(columns["starts"].to_pylist(), columns["ends"].to_pylist()):
        runs: list[list[int]] = []
        for a, b in sorted(zip(s, e)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        starts.append([r[0] for r in runs])
        ends.append([r[1] for r in runs])
    items = [sorted(set(x)) for x in columns["items"].to_pylist()]
    return {**{k: columns[k] for k in ("row", "doc_id", "key", "n_words")}, "starts": starts, "ends": ends, "items": items}


def window_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = MAX_BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """(row, doc_id, key, n_words, starts, ends, items): the hit words of each row as maximal runs, and the items that occur.

    The benchmark is measured. Up to ``block_bytes`` of text it goes to the tasks whole; beyond, it is cut by hash into blocks
    of about that size, each searched in a pass of its own, and the runs of a row are joined. Null texts have no words;
    items without words are left out, and those without an id are searched but named nowhere in ``items``; an empty table on either side gives no rows or no hits. ``key`` names a
    column of ``docs`` to be carried as text, else it is null.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    if blocks > 1:
        rows = stored(rows)
    spark, passes = docs.sparkSession, []
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        windows = spark.sparkContext.broadcast([tuple(r) for r in some.collect()])  # at most about block_bytes
        passes.append(map_batches(rows, partial(_search, given=windows, window=window), SPANS, _FIELDS))
    if blocks == 1:
        return passes[0]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    joined = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])
    return map_batches(joined, _merge, SPANS, _FIELDS)


_BUILT: dict = {}


def _search(columns: dict, given, window: int) -> dict:
    key = (given.id if hasattr(given, "id") else id(given), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (given, Windows(given.value, window))
    return _spans(columns, _BUILT[key][1])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = MAX_BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row, before them the column named ``key`` if given.

    Benchmark rows with a null id count in n_hit and contaminated; n_items and items_sha256 are of the distinct ids that are not
    null. Other null and edge cases as in ``window_spans``.
    """
    spans = window_spans(docs, benchmark, window, block_bytes, key)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select(
        *([F.col("key").alias(key)] if key else []), "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
