"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the lattice of pieces.

A text is its UTF-8 bytes, a space standing for the piece mark, so nothing is normalised and nothing is lost; a character
that no piece covers is spelt in byte pieces, as is the piece mark itself. No piece reaches over a cut (before the spaces behind
another character, and around line ends), so the cuts' segments are lattices of their own, and equal ones are filtered once.

Forward: a trie finds all pieces from every byte on, all segments at once. Within a segment, places that no piece found runs over
are cuts as well, so text without blanks falls into short parts; the log mass of a node, from the cut before it on, is the sum over
the pieces that end there. All parts move in rounds of arrays, but for parts of more than LONG bytes, which a plain loop takes
from piece to piece. Backward: from each part's end a piece is drawn by its share of the node's mass, with a uniform number
made from the seed, the row's key and the node's byte position. So a row's result doesn't depend on batches or tasks.

A piece's log weight is ``alpha`` times its log probability: the score of a unigram model; for other models, whose scores
are only merge ranks, minus the log of the rank (Zipf's law).
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import BATCH_BYTES, map_batches, small_batches
from auditlake.llm.shingles import mix

CHUNK = 1 << 21
SPLIT = 48  # bytes of a segment from which on cuts are looked for
LONG = 512  # bytes of a part without cuts from which on a plain loop beats rounds of arrays
ALPHA = 1.0
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Byte strings in an open-addressing table of (node, byte) to node."""

    def __init__(self, words: list[bytes], values: list[int]):
        edges: dict[int, int] = {}
        self.value = [-1]
        for word, value in zip(words, values):
            node = 0
            for byte in word:
                key = node << 8 | byte
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(self.value)
                    self.value.append(-1)
            self.value[node] = value
        self.value = np.array(self.value, np.int32)
        self.bits = max(4, (2 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nodes = np.full(1 << self.bits, -1, np.int32)
        left, to = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.nodes[slot[one]] = left[one], to[one]
            rest = self.keys[slot] != left
            left, to, slot = left[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        keys = node.astype(np.int64) << 8 | byte
        slot = self._slot(keys)
        found = self.keys[slot]
        child = np.where(found == keys, self.nodes[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            child[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return child


class Pieces:
    """A model's pieces as bytes, with their log weights."""

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int64)
        self.surface: list[bytes] = [b""] * n
        words, ids = [], []
        scores = [model.get_score(i) for i in range(n)]
        ranks = all(float(s).is_integer() for s in scores)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[3:-1], 16)
                self.byte_id[byte], self.surface[i] = i, bytes([byte])
            elif not special[i]:
                self.surface[i] = piece.replace(MARK, " ").encode()
                words.append(self.surface[i])
                ids.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model needs pieces for all bytes, or texts can't be kept whole")
        least = min((s for s in scores if s > -1e8), default=0.0)
        self.weight = alpha * np.array([-np.log1p(-max(s, least - 1)) if ranks else s for s in scores])
        self.byte_weight = alpha * (-np.log(n) if ranks else least - 10)
        self.trie = Trie(words, ids)
        self.whole = any(" " in w.decode()[1:] and w.strip(b" ") for w in words) or any(b"\n" in w and len(w) > 1 for w in words)
        self.lengths = np.array([len(s) for s in self.surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces joined, nothing else."""
        n = self.lengths[ids]
        return self.bytes[np.arange(int(n.sum())) + np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)].tobytes()


@lru_cache(maxsize=4)
def pieces_of(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def cuts_of(data: np.ndarray, starts: np.ndarray, whole: bool) -> np.ndarray:
    """Where segments begin; ``starts`` are where texts do."""
    new = np.zeros(len(data), bool)
    if not whole:
        space, line = data == 32, data == 10
        new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    new[starts[starts < len(data)]] = True
    return np.flatnonzero(new)


class Lattices:
    """The lattices of distinct segments, laid out one behind another with a node before each byte and one at the end."""

    def __init__(self, segments: list[bytes], pieces: Pieces):
        sizes = np.array([len(s) for s in segments], np.int64)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        data = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
        n = len(data)
        inside = np.ones(n, bool)
        inside[self.last] = False
        lead = inside & ((data & 0xC0) != 0x80)
        # Pieces from every character on.
        at = np.flatnonzero(lead)
        node = np.zeros(len(at), np.int32)
        froms, ids, depth = [], [], 0
        lengths = []
        alone = np.zeros(n, bool)  # characters that are a piece
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        while len(at):
            good = inside[at + depth]
            at, node = at[good], node[good]
            node = pieces.trie.step(node, data[at + depth])
            good = node >= 0
            at, node = at[good], node[good]
            depth += 1
            value = pieces.trie.value[node]
            end = value >= 0
            froms.append(at[end])
            ids.append(value[end].astype(np.int64))
            lengths.append(np.full(int(end.sum()), depth))
            alone[at[end & (width[at] == depth)]] = True
        spelt = np.flatnonzero(lead & ~alone)
        froms.append(spelt)
        ids.append(np.full(len(spelt), -1))
        lengths.append(width[spelt])
        start, ids, length = (np.concatenate(x) for x in (froms, ids, lengths))
        weight = np.where(ids >= 0, pieces.weight[np.maximum(ids, 0)], pieces.byte_weight * length)
        stop = start + length
        # No piece runs over a cut, so all segmentations meet there and the parts between cuts are filtered by themselves. Segments
        # of a few bytes are parts as they are.
        cut = np.zeros(n, bool)
        if (big := sizes > SPLIT).any():
            crossed = np.cumsum(np.bincount(start + 1, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0
            cut = ~crossed & np.repeat(big, sizes + 1)
        cut[self.first] = cut[self.last] = True
        self.nth = np.cumsum(cut) - 1
        self.cuts = np.flatnonzero(cut)
        begin = self.cuts[self.nth[stop - 1]]  # the cut before a piece's end
        long = np.diff(self.cuts, append=n)[self.nth[stop - 1]] > LONG
        # Pieces by their end's place in the part, so that each round needs only earlier ones; those of long parts one by one.
        order = np.lexsort((stop, np.where(long, 0, stop - begin), long) if long.any() else (stop, stop - begin))
        start, stop, ids, weight = start[order], stop[order], ids[order], weight[order]
        place, quick = (stop - begin[order]), len(start) - int(long.sum())
        mass = np.full(n, -np.inf)
        mass[cut] = 0.0
        share = np.empty(len(start))
        rounds = np.flatnonzero(np.diff(place[:quick], prepend=-1))
        heads = np.flatnonzero(np.diff(stop, prepend=-1))
        where = np.searchsorted(heads, [*rounds, quick])
        for r, (a, b) in enumerate(zip(rounds.tolist(), [*rounds[1:].tolist(), quick])):
            h = heads[where[r] : where[r + 1]] - a
            value = mass[start[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, h)
            many = np.diff(h, append=b - a)
            each = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(each, h)
            ends = stop[a:b][h]
            mass[ends] = np.where(cut[ends], 0.0, top + np.log(total))
            share[a:b] = each / np.repeat(total, many)
        if quick < len(start):
            share[quick:] = _filter_one_by_one(start[quick:], stop[quick:], weight[quick:], cut)
        self.start, self.id, self.quick, self.long_stop = start, ids, quick, stop[quick:]
        # For each node its pieces, with the running share up to each.
        self.edge = np.full(n, -1, np.int64)
        self.edge[stop[heads]] = heads
        running = np.cumsum(share)
        counts = np.diff(heads, append=len(start))
        self.upto = running - np.repeat(running[heads] - share[heads], counts)
        self.upto[np.append(heads[1:], len(start))[: len(heads)] - 1] = 2.0  # the last piece takes what rounding leaves


def _filter_one_by_one(start: np.ndarray, stop: np.ndarray, weight: np.ndarray, cut: np.ndarray) -> list[float]:
    """The pieces' shares at their ends for parts too long for rounds; pieces come by their ends, each with few others."""
    froms, ends, weights = start.tolist(), stop.tolist(), weight.tolist()
    mass: dict[int, float] = {}
    shares: list[float] = []
    i, n, exp, log = 0, len(ends), math.exp, math.log
    while i < n:
        end, j = ends[i], i
        values = []
        while j < n and ends[j] == end:
            values.append(mass.get(froms[j], 0.0) + weights[j])  # a part's first node has 0
            j += 1
        top = max(values)
        parts = [exp(v - top) for v in values]
        total = sum(parts)
        shares += [p / total for p in parts]
        if not cut[end]:
            mass[end] = top + log(total)
        i = j
    return shares


def _uniform(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (mix(key ^ mix(position.astype(np.uint64) * _STEP)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(data: np.ndarray, begin: np.ndarray, key: np.ndarray, offset: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For each byte the id of the piece that ends with it, or -1.

    ``begin`` are the segments' first bytes, ``key`` and ``offset`` each segment's row key and its byte position in the row.
    A walk goes back from the end of each part between cuts; those of long parts go one after another.
    """
    raw = data.tobytes()
    ends = np.append(begin[1:], len(data))
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(raw[s:e], len(distinct)) for s, e in zip(begin.tolist(), ends.tolist())], np.int64)
    lattices = Lattices(list(distinct), pieces)
    first = lattices.first[which]
    low, high = lattices.nth[first], lattices.nth[lattices.last[which]]
    parts = high - low
    segment = np.repeat(np.arange(len(begin)), parts)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(parts) - parts, parts) + low[segment]
    bottom, node = lattices.cuts[nth], lattices.cuts[nth + 1]
    out = np.full(len(data), -1, np.int64)

    def put(end: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        normal = ids >= 0
        out[end[normal]] = ids[normal]
        for e, n in zip(end[~normal].tolist(), size[~normal].tolist()):
            out[e - n + 1 : e + 1] = pieces.byte_id[data[e - n + 1 : e + 1]]

    long = node - bottom > LONG
    for s, b, t in zip(segment[long].tolist(), bottom[long].tolist(), node[long].tolist()):
        nodes, taken = _walk(lattices, b, t, _uniform(key[s], offset[s] + np.arange(b, t + 1) - first[s]).tolist())
        starts = lattices.start[taken]
        put(begin[s] + nodes - first[s] - 1, nodes - starts, lattices.id[taken])
    lane = np.flatnonzero(~long)
    node = node[lane]
    while len(lane):
        s = segment[lane]
        place = node - first[s]
        u = _uniform(key[s], offset[s] + place)
        edge = lattices.edge[node]
        more = np.flatnonzero(lattices.upto[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[lattices.upto[edge[more]] <= u[more]]
        start = lattices.start[edge]
        put(begin[s] + place - 1, node - start, lattices.id[edge])
        go = start > bottom[lane]
        lane, node = lane[go], start[go]
    return out


def _walk(lattices: Lattices, bottom: int, node: int, u: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, pieces taken there) from the end of a part back to its beginning; ``u`` by node from the beginning on."""
    # The pieces of a long part lie behind one another.
    low, high = (lattices.quick + np.searchsorted(lattices.long_stop, [bottom, node], side="right")).tolist()
    edge, upto, start = lattices.edge[bottom + 1 : node + 1].tolist(), lattices.upto[low:high].tolist(), lattices.start[low:high].tolist()
    nodes, taken = [], []
    while node > bottom:
        e = edge[node - bottom - 1] - low
        while upto[e] <= u[node - bottom]:
            e += 1
        nodes.append(node)
        taken.append(e + low)
        node = start[e]
    return np.array(nodes, np.int64), np.array(taken, np.int64)


def sample_all(texts: list[bytes], keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """The sampled ids of each text; ``keys`` are 64-bit numbers that seed the rows."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    cuts = cuts_of(data, starts, pieces.whole)
    row = np.searchsorted(starts + sizes, cuts, side="right")
    found = np.full(len(data), -1, np.int64)
    a = 0
    while a < len(cuts):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK)))
        stop = cuts[b] if b < len(cuts) else len(data)
        found[cuts[a] : stop] = sample(data[cuts[a] : stop], cuts[a:b] - cuts[a], keys[row[a:b]], cuts[a:b] - starts[row[a:b]], pieces)
        a = b
    return [x[x >= 0] for x in (found[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist()))]


def row_keys(ids: list, seed: int) -> np.ndarray:
    known = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    return mix(mix(known + _STEP) + np.uint64(seed % (1 << 64)) + np.array([i is None for i in ids], np.uint64))


def _encode(columns: dict, path: str, alpha: float, seed: int, with_ids: bool) -> dict:
    pieces = pieces_of(path, alpha)
    texts = [t or b"" for t in columns["text"].cast(pa.binary()).to_pylist()]
    ids = sample_all(texts, row_keys(columns["doc_id"].to_pylist(), seed), pieces)
    back = [pieces.decode(x) for x in ids]
    return {
        "doc_id": columns["doc_id"], "n_bytes": [len(t) for t in texts], "n_pieces": [len(x) for x in ids],
        "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "decoded_crc32": [zlib.crc32(b) for b in back],
        "lossless": [a == b for a, b in zip(texts, back)], "ids": [x.astype(np.int32) if with_ids else None for x in ids],
    }


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("lossless", pa.bool_()), ("ids", pa.list_(pa.int32()))])
ENCODED = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean, ids array<int>"


def sampled_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, decoded_crc32, lossless, ids) per row; ids are little-endian u32 for the checksum.

    A null text is empty and has no pieces. Rows with equal ids and texts get equal results; null ids share a
    seed. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = map_batches(rows, partial(_encode, path=path, alpha=alpha, seed=seed, with_ids=with_ids), ENCODED, _FIELDS)
    small_batches(docs.sparkSession, size=BATCH_BYTES // 2)
    return made
