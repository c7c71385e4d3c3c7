"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_OF_BYTE[0x41:0x5B] = _OF_BYTE[0x61:0x7B]  # lower case
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


OTHERS = np.ones(256, bool)  # all bytes but those of letters
OTHERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_hashes(texts: list[bytes], apart: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hashes of all words, A-Z in lower case; for each text and the end the words before it).

    Words are runs without the bytes ``apart``, ASCII white space if not given. For each number in ``heads`` an array
    follows with the hashes of the words' first so many bytes.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~apart[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), *(np.zeros(0, np.uint64) for _ in heads)
    sizes = stops - starts
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _MIX | np.uint64(1))]))
    inside = np.flatnonzero(word)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    each = _OF_BYTE[data[inside]] * power[place]
    of_heads = [mix(np.add.reduceat(np.where(place < n, each, np.uint64(0)), first) + np.uint64(n)) for n in heads]
    return mix(np.add.reduceat(each, first) + sizes.astype(np.uint64)), np.concatenate([[0], np.searchsorted(starts, ends)]), *of_heads


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted; of fewer words the whole sequence as one."""
    words, first = word_hashes(texts)
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        rolled = (rolled + words[k : k + n]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    rolled = mix(rolled)
    sets = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= width:
            sets.append(distinct(rolled[s : e - width + 1]))
        elif e > s:
            whole = np.array([e - s], np.uint64)
            for w in words[s:e]:
                whole = mix(whole * _MIX + w)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The number of values in both of two sorted arrays without repeats."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))
