"""Whole texts through the ``tokenizers`` library, each distinct unit of a worker encoded once.

A byte-level pre-tokenizer of the pattern ``'s|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` never
joins what stands before a single space between two other characters with what stands after it: no alternative
but the two for white space runs over a space, those need white space on both sides, and a token begun after such a
space depends on nothing before it. So a text may be cut before each such space, the cuts (units) encoded one
by one, and their ids joined: the result is that of the whole text. Added tokens hold no space, so their strings
are found within units as in the whole text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters, other marks but the apostrophe, and the same once more behind a line end: each of these ends a token of the
#: pattern, whatever stands beside it, so such a unit is the sum of its pieces. Written for Arrow's regular expressions.
PIECES = r"\A(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]{1,64})(?P<b>[!-&(-/:-@\[-`{-~]{0,16})(?:(?P<c>\n)(?P<d>[A-Za-zÀ-ÖØ-öø-ÿ]{1,64})(?P<e>[!-&(-/:-@\[-`{-~]{0,16}))?\z"
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MAX_CACHED = 700_000
MAX_UNIT = 64
MAX_ADDED = 32  # characters of an added token, the least margin of a chunk


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer per worker and file; it uses no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def check_tokenizer(path: str) -> None:
    """Raise unless the file is one whose texts may be cut as said above."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    bytes_alone = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = [t for t in made.get("added_tokens") or [] if len(t["content"]) >= MAX_ADDED or any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if not bytes_alone or made.get("normalizer") or made.get("truncation") or added:
        raise ValueError(f"{path}: needs a byte-level pre-tokenizer with its own pattern, no normalizer, and added tokens without blanks, of fewer than {MAX_ADDED} characters")


def clean(unit: str) -> bool:
    """Whether a space before and behind the unit is a safe cut."""
    return unit != "" and not unit[0].isspace() and not unit[-1].isspace()


def _strings(array: pa.Array) -> list:
    """As ``to_pylist``, without an Arrow scalar for each value."""
    return array.to_numpy(zero_copy_only=False).tolist()


class UnitCache:
    """What ``of(ids)`` makes of every unit met lately: at most twice MAX_CACHED results between batches.

    ``of`` must turn lists of ids into something that ``+`` joins as lists are joined; ``none`` is that of no text.
    A unit of letters alone is one pre-token, so the library's model is asked for it directly, past its pre-tokenizer.
    """

    def __init__(self, path: str, of: Callable):
        loaded = tokenizer(path)
        self.encode = loaded.encode_batch_fast
        added = loaded.get_added_tokens_decoder().values()
        self.model = loaded.model if loaded.normalizer is None and not any(LETTERS.fullmatch(t.content.strip()) for t in added) else None
        self.of = of
        self.none = of([])
        self.known: dict = {}
        self.older: dict = {}
        self.bare: dict = {}  # without a space before

    def batch(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(results, places, bounds): text i is results[places[bounds[i]]], ... up to bounds[i + 1], in order.

        Arrow cuts the texts and finds the distinct units, so Python sees each once. A text with other white space at a cut
        is taken as one unit.
        """
        texts = texts.fill_null("")
        cuts = pc.split_pattern(texts, " ")
        bounds = cuts.offsets.to_numpy().astype(np.int64)
        units = cuts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        places = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = _strings(units.dictionary)
        results, unsafe = self._results(units.dictionary, words)
        first = bounds[:-1]
        heads = [words[i] for i in places[first].tolist()]
        bad = unsafe[places]
        bad[first] = np.array([h == "" or h[-1].isspace() for h in heads], bool) & (np.diff(bounds) > 1)
        whole = np.logical_or.reduceat(bad, first)
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()
        encoded = self._encoded(set(heads), "")
        places[np.repeat(whole, np.diff(bounds))] = len(words)  # nothing
        places[first] = len(words) + 1 + np.arange(len(heads))
        return [*results, self.none, *(encoded[h] for h in heads)], places, bounds

    def _results(self, units: pa.Array, words: list[str]) -> tuple[list, np.ndarray]:
        """What the units are, each behind a space, and which are unsafe; those are nothing."""
        if len(self.known) > MAX_CACHED:
            self.older, self.known = self.known, {}
        if len(self.bare) > MAX_CACHED // 4:
            self.bare = {}
        known, older, bare = self.known, self.older, self.bare
        found = list(map(known.get, words))
        unsafe = np.zeros(len(words), bool)  # none that is known
        holes = [i for i, r in enumerate(found) if r is None]
        if older:
            for i in holes:
                if (old := older.get(words[i])) is not None:
                    found[i] = known[words[i]] = old
            holes = [i for i in holes if found[i] is None]
        if not holes:
            return found, unsafe
        letters = [u for i in holes if len(u := words[i]) <= MAX_UNIT and u.isalpha()]
        self._learn_letters(letters)  # by themselves, the most frequent kind
        for i in holes:
            found[i] = known.get(words[i])
        holes = [i for i in holes if found[i] is None]
        pieces = pc.extract_regex(units.take(pa.array(holes, pa.int64())), PIECES)
        columns = [_strings(pieces.field(c)) for c in "abcde"]
        whole = pc.is_valid(pieces).to_numpy(zero_copy_only=False).tolist()
        a, b, c, d, e = columns
        self._learn_letters(list({x for x, ok in zip(a, whole) if ok}.difference(known)))
        bare.update(self._encoded({x for part in (b, c, d, e) for x, ok in zip(part, whole) if ok}.difference(bare), ""))
        rest = []
        for i, ok, x, y, z, v, w in zip(holes, whole, a, b, c, d, e):
            if not ok:
                rest.append(i)
                continue
            r = known[x]
            if y:
                r = r + bare[y]
            if z:
                r = r + bare[z] + bare[v] + bare[w]
            found[i] = r
            u = words[i]
            if len(u) <= MAX_UNIT:
                known[u] = r
        if rest:
            safe = [i for i in rest if clean(words[i])]
            unsafe[rest] = True
            unsafe[safe] = False
            encoded = self._encoded({words[i] for i in safe}, " ")
            known.update((u, r) for u, r in encoded.items() if len(u) <= MAX_UNIT)
            for i in rest:
                found[i] = encoded.get(words[i], self.none)
        return found, unsafe

    def _learn_letters(self, letters: list[str]) -> None:
        """Put words of letters alone, behind a space, into ``known``."""
        if self.model:
            tokenize, of, mark = self.model.tokenize, self.of, BYTE_CHARS[0x20]
            plain = [u for u in letters if u.isascii() or LETTERS.fullmatch(u)]
            self.known.update((u, of([t.id for t in tokenize(mark + u if u.isascii() else (" " + u).encode().decode("latin-1").translate(BYTE_CHARS))])) for u in plain)
            letters = [u for u in letters if u not in self.known]
        self.known.update(self._encoded(letters, " "))

    def _encoded(self, units, before: str, step: int = 4096) -> dict:
        known, units = {}, list(units)
        for at in range(0, len(units), step):
            some = units[at : at + step]
            known.update(zip(some, (self.of(e.ids) for e in self.encode([before + u for u in some], add_special_tokens=False))))
        return known


def _packed(code: str) -> Callable[[list[int]], bytes]:
    if sys.byteorder == "little":
        return lambda ids: array(code, ids).tobytes()
    return lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)


#: What a cache keeps of a unit's ids: their number, or their bytes by the type's code.
KINDS = {"count": len, "H": _packed("H"), "I": _packed("I")}


@lru_cache(maxsize=2)
def unit_cache(path: str, kind: str) -> UnitCache:
    """The cache that all tasks of a reused worker share; named, as functions sent to tasks are new objects in each."""
    return UnitCache(path, KINDS[kind])


def ids_of(results: list[bytes], places: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the texts' bounds in them) of a batch whose results are the bytes of ids of ``kind``."""
    table = np.frombuffer(b"".join(results), kind)
    sizes = np.fromiter(map(len, results), np.int64, len(results)) // np.dtype(kind).itemsize
    starts = np.cumsum(sizes) - sizes
    each = sizes[places]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    ids = table[np.arange(total) + np.repeat(starts[places] - (ends - each), each)]
    return ids, np.concatenate([[0], ends])[bounds]
