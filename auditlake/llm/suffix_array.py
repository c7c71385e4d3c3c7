"""Suffix arrays of a byte string in numpy: Larsson-Sadakane refinement, and Kasai's rule for common prefixes."""

from __future__ import annotations

import numpy as np

FIRST = 8


def words_at(data: np.ndarray) -> np.ndarray:
    """For each position the 8 bytes from there on as a number in the order of bytes; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(FIRST, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least ``depth`` bytes from there on (or up to the end); beyond that, by no rule.

    First all positions are sorted by 8 bytes. Then only the groups still tied are sorted, by the rank of the position
    as far behind as is sorted so far, so each round doubles the depth and leaves sorted groups alone.
    """
    n = len(data)
    keys = words_at(data)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = FIRST
    while h < depth:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]]))) if n else np.zeros(0, np.int64)
        if not len(tied):
            break
        some = order[tied]
        keys = (rank[some] << 32) + rank[np.minimum(some + h, n)] + 1
        by = np.argsort(keys, kind="stable")
        keys, some = keys[by], some[by]
        order[tied] = some
        new[tied] = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[some] = tied[np.maximum.accumulate(np.where(new[tied], np.arange(len(tied)), 0))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """For each place in ``order`` but the first, the common prefix with the one before, exact up to ``enough``.

    Kasai's rule: where the neighbour of position p is one behind that of p - 1, the common prefix is one shorter, and needs
    no comparison. Only where such a run begins, every ``enough`` positions, and behind a difference are bytes compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = words_at(data)
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(head, place, 0))
    head |= (place - start) % enough == 0
    found = np.zeros(n, np.int64)

    def compare(some: np.ndarray, most: int) -> None:
        a, b, done = some.copy(), before[some], np.zeros(len(some), np.int64)
        live = np.flatnonzero(b >= 0)
        for step in range(0, most, FIRST):
            x, y = a[live] + step, b[live] + step
            inside = np.maximum(x, y) < n
            live, x, y = live[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            room = np.minimum(n - np.maximum(x, y), FIRST)
            same = np.full(len(live), FIRST)
            odd = differ != 0
            same[odd] = (63 - np.floor(np.log2(differ[odd].astype(np.float64)))).astype(np.int64) // 8
            if odd.any():  # rounding may take a number up to the next power of two
                d, s = differ[odd], same[odd]
                same[odd] = np.where((d >> (np.uint64(56) - np.uint64(8) * np.minimum(s, 7).astype(np.uint64))) == 0, s + 1, s)
            done[live] += np.minimum(same, room)
            live = live[(same == FIRST) & (room == FIRST)]
            if not len(live):
                break
        found[some] = done

    compare(np.flatnonzero(head), 2 * enough)
    start = np.maximum.accumulate(np.where(head, place, 0))
    found = found[start] - (place - start)
    behind = np.flatnonzero((found <= 0) & ~head)
    compare(behind, enough)
    return np.minimum(found[order[1:]], enough)
