"""Nearest vectors of many queries among many vectors: an inverted file with probes, and exact re-ranking.

Centroids are fitted by spherical k-means on a bounded sample, in one task. Every vector is stored in the cell of its nearest
centroid. A query asks the cells whose centroids are nearest to it; how many is measured on the sample, so that they hold the
asked share of true neighbours. Queries and vectors meet by equi-join on (cell, block): cells and queries of a cell are cut
to blocks of bounded size, so a cell with a third of all vectors is many tasks' work, and a task holds two blocks and the best
``k`` per query, never pairs. All cosines are worked out on the whole vectors.

With ``exact`` a second pass asks every other cell that could hold a better vector than the k-th found: the angle between a query
and a member is at least the angle to the centroid less the cell's radius. On clustered vectors few cells are left.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.retrieval import _HITS, HIT_SCHEMA, BestPerQuery, _batch, _merge, _unit
from auditlake.session import written

MAX_SAMPLE = 20_000
MAX_CELLS = 4_096
CELLS_PER_ROOT = 4  # cells for each unit of the square root of the number of vectors
RECALL = 0.97  # of the sample's neighbours, that fewer and so farther than those of all vectors
ROUNDS = 10
VECTORS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 2_048
_TRIED = 256
_ROWS = 1_024
_SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (cell, id, vector) are stored; vectors have length 1 or 0. ``held`` and ``radius`` are by cell."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame
    held: np.ndarray
    radius: np.ndarray


def _units(vectors: pa.Array) -> np.ndarray:
    return _unit(vectors) if len(vectors) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + _ROWS] @ centroids.T).argmax(axis=1) for i in range(0, len(x), _ROWS)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids; a cell that loses all its rows keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        cell = _nearest(x, centroids)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums = np.add.reduceat(x[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        whole = length[:, 0] > 0
        centroids = centroids.copy()
        centroids[cell[order][first][whole]] = sums[whole] / length[whole]
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """The least number of cells that holds the share ``recall`` of the sample's ``k`` nearest, asked for its first rows."""
    tried, cell = x[:_TRIED], _nearest(x, centroids)
    scores = tried @ x.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -2  # not itself
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    places = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def _fit(batches: Iterator[pa.RecordBatch], cells: int, recall: float, k: int) -> Iterator[pa.RecordBatch]:
    parts = [_units(b.column("vector")) for b in batches if b.num_rows]
    if parts:
        x = np.concatenate(parts)
        centroids = k_means(x, min(cells, len(x)))
        made = pickle.dumps((centroids, probes_for(x, centroids, recall, k)))
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.binary())})


def _clean(frame: DataFrame, key: str) -> DataFrame:
    """Null vectors, and those with a null in them, are left out."""
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    return frame.filter(whole).select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


_PLACED = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("angle", pa.float64())])
_ASKED = pa.schema([("cell", pa.int32()), ("query_id", pa.int64()), ("vector", pa.list_(pa.float64()))])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def build_index(vectors: DataFrame, recall: float = RECALL, k: int = 5, max_sample: int = MAX_SAMPLE, max_cells: int = MAX_CELLS) -> VectorIndex | None:
    """Index every vector of (ord, vector); centroids come from at most ``max_sample`` rows, the least by hash. None if there are none.

    Vectors of different lengths are an error.
    """
    spark, rows = vectors.sparkSession, _clean(vectors, "ord")
    n = rows.count()
    cells = max(1, min(max_cells, int(CELLS_PER_ROOT * n**0.5), n // 2))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("vector")
    fitted = sample.coalesce(1).mapInArrow(partial(_fit, cells=cells, recall=recall, k=k), "made binary").first()
    if fitted is None:
        return None
    centroids, probes = pickle.loads(fitted["made"])
    sent = spark.sparkContext.broadcast(centroids)  # at most ``max_cells`` vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                x = _unit(pa.concat_arrays([part.column("vector")]))
                near = x @ sent.value.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column("id"), _lists(x), pa.array(_angle(near.max(axis=1)))], schema=_PLACED)

    placed = written(rows.mapInArrow(place, "cell int, id long, vector array<double>, angle double"))
    held, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row per cell
        held[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    return VectorIndex(centroids, probes, placed.drop("angle"), held, radius)


def _compare(vectors: pa.Table, asked: pa.Table, k: int, scale: int) -> pa.Table:
    """The best ``k`` of a block of vectors for each query of a block."""
    if not vectors.num_rows or not asked.num_rows:
        return pa.table(_batch(_HITS, *[np.zeros(0, np.int64)] * 3))
    best = BestPerQuery(asked.num_rows, k)
    x, q = (_units(t.column("vector").combine_chunks()) for t in (vectors, asked))
    ids = vectors.column("id").to_numpy()
    for low in range(0, len(x), _ROWS):
        best.add(np.rint(q @ x[low : low + _ROWS].T * scale).astype(np.int64), ids[low : low + _ROWS])
    return pa.Table.from_batches([best.batch(asked.column("query_id").to_numpy())])


def _meet(index: VectorIndex, asked: DataFrame, k: int, scale: int) -> DataFrame:
    """Hits of the queries (cell, query_id, vector) among the cells' vectors."""
    spark = asked.sparkSession
    wanted = np.zeros(len(index.held), np.int64)
    for r in asked.groupBy("cell").count().collect():  # a row per cell
        wanted[r["cell"]] = r["count"]
    used = np.flatnonzero((wanted > 0) & (index.held > 0)).tolist()
    blocks = spark.createDataFrame([(c, -(-int(index.held[c]) // VECTORS_PER_BLOCK), -(-int(wanted[c]) // QUERIES_PER_BLOCK)) for c in used], "cell int, v int, q int")
    key = ["cell", "vb", "qb"]

    def dealt(frame: DataFrame, own: str, of: str, name: str, other: str, copies: str) -> DataFrame:
        placed = frame.join(F.broadcast(blocks), "cell").withColumn(name, F.pmod(F.xxhash64(own), F.col(of)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).select(*key, own, "vector")

    v, q = dealt(index.rows, "id", "v", "vb", "qb", "q"), dealt(asked, "query_id", "q", "qb", "vb", "v")
    return v.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(partial(_compare, k=k, scale=scale), HIT_SCHEMA)


def _cells(index: VectorIndex, queries: DataFrame, pick) -> DataFrame:
    """(cell, query_id, vector): each query once for every cell that ``pick`` (cosines with centroids, batch) marks."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS // 4):
                part = batch.slice(low, _ROWS // 4)
                x = _unit(pa.concat_arrays([part.column("vector")]))
                row, cell = np.nonzero(pick(x @ sent.value.T, part))
                for at in range(0, len(row), 1 << 14):
                    some = row[at : at + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + (1 << 14)], pa.int32()), part.column("id").take(pa.array(some)), _lists(x[some])], schema=_ASKED)

    return queries.mapInArrow(ask, "cell int, query_id long, vector array<double>")


def _first_cells(near: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row, ties to the lower cell."""
    order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    marked = np.zeros(near.shape, bool)
    np.put_along_axis(marked, order, True, axis=1)
    return marked


def knn_indexed(index: VectorIndex | None, queries: DataFrame, k: int = 5, digits: int = 6, exact: bool = False) -> DataFrame:
    """(query_id, ord, cosine, rank) of the index's vectors for (query_id, vector), rank 1..k.

    Cosines are rounded to ``digits``; ties go to the lower ord; null vectors are left out, a zero vector has cosine 0 with all. Query
    ids must be unique. Without ``exact`` a neighbour in a cell that was not asked is missed. No vectors, no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, scale = queries.sparkSession, 10**digits
    if index is None:
        return spark.createDataFrame([], "query_id long, ord long, cosine double, rank int")
    asked, probes = _clean(queries, "query_id"), index.probes
    ranked = _merge(_meet(index, written(_cells(index, asked, lambda near, _: _first_cells(near, probes))), k, scale), k)
    if exact:
        first = written(ranked)
        least = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        with_least = asked.join(least, F.col("id") == F.col("query_id"), "left").select("id", "vector", "least")
        radius, held = index.radius, index.held > 0

        def open_cells(near: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            bound = np.cos(np.maximum(0.0, _angle(near) - radius - _SLACK)) * scale
            worst = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.isnan(worst)[:, None] | (bound + 1 >= worst[:, None])
            return reach & held & ~_first_cells(near, probes)

        more = _meet(index, written(_cells(index, with_least, open_cells)), k, scale)
        ranked = _merge(first.drop("rank").unionByName(more), k)
    cosine = (F.col("score") / F.lit(float(scale))).alias("cosine")
    return ranked.select("query_id", "ord", cosine, F.col("rank").cast("int").alias("rank"))
