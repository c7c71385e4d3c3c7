"""Removal of every byte in a string of LENGTH bytes that starts earlier as well, by suffix arrays over shards.

Suffixes can't all be shuffled, so shards are made by content. Each window of LENGTH bytes has an anchor, its gram of least hash
(the leftmost of equals), so equal windows have equal anchors at equal places; on average one position in 35 is one.

1. Anchors. Each task sorts the grams of its anchors. What it sees twice it knows to be shared; of the rest it asks, by hash,
   the sorted lists of the other tasks. Nearly all anchors of text that occurs once end here, at 8 bytes each.
2. Segments. A shard of documents finds its anchors in the merged list of shared ones by binary search and cuts out the bytes of
   each shared anchor's windows. Equal segments of a shard are sent once, to the shard of the gram's hash. For a gram
   that is shared very often (a bounded number), single windows are sent by their own hash, so what varies around a hot
   passage is spread.
3. Suffix arrays. Each content shard holds whole classes of equal windows. Equal segments of several document shards are merged;
   a suffix array with common prefixes over the rest gives the classes, and all but the earliest window of each are repeats.
4. Removal. The runs of repeated windows go back to the document shards, which join them and cut the texts.

Texts that equal an earlier text as a whole are found by hash beforehand and take no part. No step holds more than a
shard of bounded bytes, whatever is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditlake.llm.common import small_batches, stored
from auditlake.llm.shingles import mix
from auditlake.llm.suffix_array import common_prefixes, suffix_order

LENGTH = 100
GRAM = 32
DOC_SHARD_BYTES = 8 << 20
CONTENT_SHARD_BYTES = 4 << 20  # of all text; segments are a part of that
ASK_BYTES = 64 << 20
PIECE = 1 << 20
FLUSH = 2 << 20
HOT_SHARE = 100_000
HOT_LEAST = 1 << 14
SPACING = 128  # more than the windows of one segment
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each position on."""
    h, width, factor = _OF_BYTE[data], 1, int(_ODD)
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return mix(h)


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the anchor's gram) for each run of windows of one text that share an anchor."""
    firsts, counts, grams = [], [], []
    for at in range(0, len(data) - length + 1, PIECE):
        h = gram_hashes(data[at : at + PIECE + length - 1], gram)
        v = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width, need = 1, length - gram + 1
        while 2 * width <= need:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if width < need:
            v = np.minimum(v[: len(v) - (need - width)], v[need - width :])
        anchor = (v & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        firsts.append(first + at)
        counts.append(np.diff(first, append=len(anchor)))
        grams.append(h[anchor[first]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(grams)


def segments_of_all(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, gram) over all texts. Short texts are cut together, which saves most of the time."""
    out: list[list] = [[], [], [], []]
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= PIECE):
            group.append(at)
            size += len(texts[at])
            at += 1
        first, count, grams = segments(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), length, gram)
        ends = np.cumsum([len(texts[i]) for i in group])
        starts = np.concatenate([[0], ends[:-1]])
        # Runs are cut where texts meet; windows that reach over an end are left out.
        limits = ends - length + 1
        of = np.searchsorted(ends, first, side="right")
        while len(first):
            of = np.searchsorted(ends, first, side="right")
            stop = first + count
            keep = np.maximum(np.minimum(stop, limits[of]) - first, 0)
            good = keep > 0
            out[0].append(np.array(group)[of[good]])
            out[1].append((first - starts[of])[good])
            out[2].append(keep[good])
            out[3].append(grams[good])
            rest = stop > ends[of]  # goes on in the next text
            first, count, grams = ends[of][rest], (stop - ends[of])[rest], grams[rest]
    return tuple(np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(out, (np.int64, np.int64, np.int64, np.uint64)))


def _ask(batches: Iterator[pa.RecordBatch], asks: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, id, grams, shards, counts): kind 0 asks list ``id``, kind 1 tells document shard ``id`` what is shared."""
    held: list = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        grams, shards = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(grams, kind="stable")
        grams, shards = grams[order], shards[order]
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(new, append=len(grams))
        asked = np.where(counts == 1, shards[new], -1).astype(np.int32)  # -1: needs no answer
        each = grams[new]
        many = np.repeat(counts > 1, counts)
        yield from _rows(0, _list_of(each, asks), [each, asked, counts.astype(np.int32)])
        told, g = shards[many], grams[many]
        if len(g):
            yield from _rows(1, told, [g])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        of, _, _, grams = segments_of_all(texts, length, gram)
        held.append((grams, shard[of]))
        size += len(grams)
        if size > FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _list_of(grams: np.ndarray, n: int) -> np.ndarray:
    return (mix(grams) % np.uint64(n)).astype(np.int64)


ASKED = "kind int, id long, grams binary, shards binary, counts binary"
_ASKED = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("grams", pa.binary()), ("shards", pa.binary()), ("counts", pa.binary())])


def _rows(kind: int, ids: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per id with the bytes of its part of each column."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    columns = [c[order] for c in columns]
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ends = np.append(new[1:], len(ids))
    for at in range(0, len(new), 256):
        spans = list(zip(new[at : at + 256].tolist(), ends[at : at + 256].tolist()))
        data = [[c[s:e].tobytes() for s, e in spans] for c in columns] + [[None] * len(spans)] * (3 - len(columns))
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(spans), pa.int32()), pa.array(ids[new[at : at + 256]], pa.int64()), *[pa.array(d, pa.binary()) for d in data]], schema=_ASKED)


_COPY = [("doc_id", pa.int64()), ("sha", pa.binary())]
_TOLD = pa.schema([("shard", pa.int64()), ("grams", pa.binary())])


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _answer(table: pa.Table, hot: int) -> pa.Table:
    """What a list of asked grams tells each document shard; shard -1 gets the grams that are shared very often."""
    if table.column("kind")[0].as_py() == 1:
        return pa.table([table.column("id"), table.column("grams")], schema=_TOLD)
    grams, shards, counts = _joined(table.column("grams"), "<u8"), _joined(table.column("shards"), "<i4"), _joined(table.column("counts"), "<i4")
    order = np.argsort(grams, kind="stable")
    grams, shards, counts = grams[order], shards[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    totals = np.add.reduceat(counts.astype(np.int64), new)
    told = np.repeat(totals > 1, np.diff(new, append=len(grams))) & (shards >= 0)
    rows = [(b.column("id"), b.column("grams")) for b in _rows(1, shards[told].astype(np.int64), [grams[told]])] if told.any() else []
    often = grams[new[totals > hot]]
    if len(often):
        rows.append((pa.array([-1], pa.int64()), pa.array([often.tobytes()], pa.binary())))
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(r), schema=_TOLD) for r in rows], schema=_TOLD)


SEGMENTS = "bucket long, shard long, docs binary, starts binary, counts binary, orders binary, bytes binary"
_SEGMENTS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), *[(c, pa.binary()) for c in ("docs", "starts", "counts", "orders", "bytes")]])
RUNS = "shard long, docs binary, starts binary, counts binary"
_RUNS = pa.schema([("shard", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])
_ORDER = np.dtype([("id", "<i8"), ("tie", ">u4")])
_NULL_ID = -(1 << 63)


def _ordered(docs: pa.Table, copies: set) -> tuple[list, list]:
    """The rows (id, hash, place) of a document shard in a fixed order, and the places in it of those that are no copies."""
    rows = sorted(zip([_NULL_ID if x is None else x for x in docs.column("doc_id").to_pylist()], docs.column("sha").to_pylist(), range(docs.num_rows)))
    own, last = [], None
    for i, (*name, _) in enumerate(rows):
        if tuple(name) not in copies and name != last:
            own.append(i)
        last = name
    return rows, own


def _copies(table: pa.Table) -> set:
    some = table.filter(table.column("sha").is_valid())
    return set(zip([_NULL_ID if x is None else x for x in some.column("doc_id").to_pylist()], some.column("sha").to_pylist()))


def _cut(key, docs: pa.Table, told: pa.Table, hot: bytes, buckets: int, length: int, gram: int) -> pa.Table:
    """The segments that a document shard sends, a row per content shard; those equal to an earlier one here as runs (bucket -1)."""
    rows, own = _ordered(docs, _copies(told))
    shared = np.unique(_joined(told.column("grams"), "<u8"))
    if not own or not len(shared):
        return _SEGMENTS.empty_table()
    raw = docs.column("text").cast(pa.binary()).to_pylist()
    texts = [raw[rows[i][2]] for i in own]
    of, first, count, grams = segments_of_all(texts, length, gram)
    at = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)  # binary search in the merged list
    hit = shared[at] == grams
    of, first, count, grams = of[hit], first[hit], count[hit], grams[hit]
    single = np.isin(grams, np.frombuffer(hot, "<u8"))
    if single.any():  # a segment for each window
        n = np.where(single, count, 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of, first, grams, single, count = np.repeat(of, n), np.repeat(first, n) + nth, np.repeat(grams, n), np.repeat(single, n), np.repeat(np.where(single, 1, count), n)
    order = np.lexsort((first, of))
    of, first, count, grams, single = of[order], first[order], count[order], grams[order], single[order]
    seen: set[bytes] = set()
    new, pieces = np.zeros(len(of), bool), []
    for i, (d, s, c) in enumerate(zip(of.tolist(), first.tolist(), count.tolist())):
        piece = texts[d][s : s + c + length - 1]
        if piece not in seen:
            seen.add(piece)
            pieces.append(piece)
            new[i] = True
    route = grams[new]
    for i in np.flatnonzero(single[new]).tolist():
        route[i] = np.frombuffer(hashlib.blake2b(pieces[i], digest_size=8).digest(), "<u8")[0]
    places = np.array(own, "<u4")[of]
    orders = np.empty(len(own), _ORDER)
    orders["id"], orders["tie"] = [rows[i][0] for i in own], [int.from_bytes(rows[i][1][:4], "big") for i in own]
    kept = np.flatnonzero(new)
    bucket = _list_of(route, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, kept = bucket[order], kept[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    out = []
    for s, e in zip(edges, [*edges[1:], len(order)]):
        j = kept[s:e]
        out.append((int(bucket[s]), places[j].tobytes(), first[j].astype("<u4").tobytes(), count[j].astype("<u2").tobytes(), orders[of[j]].tobytes(), b"".join([pieces[x] for x in order[s:e].tolist()])))
    j = np.flatnonzero(~new)
    if len(j):
        out.append((-1, places[j].tobytes(), first[j].astype("<u4").tobytes(), count[j].astype("<u2").tobytes(), None, None))
    return pa.Table.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([key[0].as_py()] * len(out), pa.int64()), *[pa.array([o[i] for o in out], pa.binary()) for i in range(1, 6)]], schema=_SEGMENTS)


def _find(table: pa.Table, length: int) -> pa.Table:
    """The runs of repeated windows among the segments of a content shard, a row per document shard."""
    if table.column("bucket")[0].as_py() == -1:
        return table.select(_RUNS.names)
    docs, starts, counts, orders = (_joined(table.column(c), k) for c, k in (("docs", "<u4"), ("starts", "<u4"), ("counts", "<u2"), ("orders", _ORDER)))
    shards = np.repeat(table.column("shard").to_numpy(), [len(x) // 4 for x in table.column("docs").to_pylist()])
    raw = b"".join(table.column("bytes").to_pylist())
    ends = np.cumsum(counts.astype(np.int64) + length - 1)
    by = np.lexsort((starts, orders["tie"], orders["id"]))
    place = {}
    whole, distinct = [], []
    for i in by.tolist():
        piece = raw[ends[i] - counts[i] - length + 1 : ends[i]]
        if piece in place:
            whole.append(i)
        else:
            place[piece] = i
            distinct.append(i)
    if len(distinct) == 1:
        data = np.zeros(0, np.uint8)
    else:
        data = np.frombuffer(b"\xff".join(place), np.uint8)  # no text holds this byte
    some = np.array(distinct)
    n = counts[some].astype(np.int64)
    base = np.cumsum(n + length) - (n + length)
    run_seg, run_first, run_n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data):
        rank = np.full(len(data), -1, np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank[np.repeat(base, n) + nth] = np.repeat(np.arange(len(some)) * SPACING, n) + nth
        order = suffix_order(data, length)
        classes = np.concatenate([[0], np.cumsum(common_prefixes(data, order, length) < length)])
        rank = rank[order]
        window = rank >= 0
        rank, classes = rank[window], classes[window]
        new = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, new), np.diff(new, append=len(rank)))
        repeats = np.sort(rank[rank != least])
        if len(repeats):
            head = np.flatnonzero(np.concatenate([[True], np.diff(repeats) != 1]))
            run_seg, run_first, run_n = some[repeats[head] // SPACING], repeats[head] % SPACING, np.diff(head, append=len(repeats))
    w = np.array(whole, np.int64)
    seg = np.concatenate([w, run_seg])
    if not len(seg):
        return _RUNS.empty_table()
    first = np.concatenate([starts[w].astype(np.int64), starts[run_seg].astype(np.int64) + run_first])
    many = np.concatenate([counts[w].astype(np.int64), run_n])
    rows = list(_rows(0, shards[seg], [docs[seg], first.astype("<u4"), many.astype("<u2")]))
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(i) for i in range(1, 5)], schema=_RUNS) for b in rows], schema=_RUNS)


def _remove(docs: pa.Table, runs: pa.Table, length: int, with_kept: bool, schema: pa.Schema) -> pa.Table:
    """The result rows of a document shard."""
    rows, own = _ordered(docs, _copies(runs))
    raw = docs.column("text").cast(pa.binary()).to_pylist()
    n = len(rows)
    doc, first, many = (_joined(runs.column(c), k).astype(np.int64) for c, k in (("docs", "<u4"), ("starts", "<u4"), ("counts", "<u2")))
    order = np.lexsort((first, doc))
    doc, first, stop = doc[order], first[order], (first + many + length - 1)[order]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    is_own = np.zeros(n, bool)
    is_own[own] = True
    out: list[list] = [[] for _ in range(5)]
    for i in range(n):
        text = raw[rows[i][2]]
        if not is_own[i]:
            starts, stops = [0], [len(text)]
        elif bounds[i] == bounds[i + 1]:
            starts, stops = [], []
        else:
            a, z = first[bounds[i] : bounds[i + 1]], np.maximum.accumulate(stop[bounds[i] : bounds[i + 1]])
            new = np.concatenate([[True], a[1:] > z[:-1]])
            starts, stops = a[new].tolist(), z[np.concatenate([new[1:], [True]])].tolist()
        kept = b"".join([text[s:e] for s, e in zip([0, *stops], [*starts, len(text)])])
        for column, value in zip(out, (len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_kept else None)):
            column.append(value)
    place = pa.array([r[2] for r in rows], pa.int64())
    carried = [docs.column(c).take(place) for c in schema.names[:2]]
    return pa.Table.from_arrays([*carried, *[pa.array(c, f.type) for c, f in zip(out, list(schema)[2:])]], schema=schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False, shard_bytes: int = DOC_SHARD_BYTES, content_bytes: int = CONTENT_SHARD_BYTES, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; ``row`` is a struct of all columns but text.

    ``kept`` is the remaining text if asked for, without the rest of characters that lost a byte; the digest is of all bytes. Earlier means a smaller doc_id, or the same document and an earlier
    start. Null ids come before all others. Rows with equal ids come in the order of their text's hash; of rows equal in both
    the first stands for the others, which are copies. Null texts are empty. Texts shorter than ``length`` lose nothing.
    Columns of other names are carried, whatever they are called. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [docs[c] for c in docs.columns if c != "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*others).alias("row"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    long = source.where(F.col("n_bytes") >= length)
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    shards, buckets, asks = (max(1, -(-total // size)) for size in (shard_bytes, content_bytes, ASK_BYTES))
    hot = max(hot_least, total // HOT_SHARE // ((length - gram + 2) // 2))
    long = long.withColumn("shard", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(shards)))
    small_batches(spark)
    narrow = long.select("shard", "doc_id", "sha")
    firsts = narrow.groupBy("sha").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first.id")
    copies = stored(narrow.join(firsts, "sha").where(F.coalesce("doc_id", F.lit(_NULL_ID)) != F.col("id")).select("shard", "doc_id", "sha"))
    asked = long.select("shard", "text").mapInArrow(partial(_ask, asks=asks, length=length, gram=gram), ASKED)
    told = stored(asked.groupBy("kind", "id").applyInArrow(lambda t: _answer(t, hot), "shard long, grams binary"))
    often = b"".join(r["grams"] for r in told.where("shard = -1").collect())  # fewer than HOT_SHARE grams
    to_shards = told.where("shard >= 0").unionByName(copies, allowMissingColumns=True)
    texts = long.select("shard", "doc_id", "sha", "text")
    cut = texts.groupBy("shard").cogroup(to_shards.groupBy("shard")).applyInArrow(lambda key, left, right: _cut(key, left, right, often, buckets, length, gram), SEGMENTS)
    runs = stored(cut.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("shard"))).applyInArrow(lambda t: _find(t, length), RUNS))
    back = runs.unionByName(copies, allowMissingColumns=True)
    done = T.StructType([T.StructField("doc_id", T.LongType()), long.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
    schema = to_arrow_schema(done)
    made = long.select("shard", "doc_id", "row", "sha", "text").groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(lambda key, left, right: _remove(left, right, length, with_kept, schema), done)
    zero = F.lit(0).cast("long")
    short = source.where(F.col("n_bytes") < length).select("doc_id", "row", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if with_kept else F.lit(None).cast("string")).alias("kept"))
    return made.unionByName(short)
