"""Retrieval: documents with the most words in common with a query, and nearest vectors.

One side is measured to be small, indexed and sent to all tasks; the other side is scanned where it
lies, in Arrow batches. A task never writes out pairs, only the best ``k`` of what it saw per query, so
a word that occurs in every document costs no shuffle. Which side is small decides the shape:

* few queries, many documents: tasks keep ``k`` per query, one small shuffle merges them;
* few documents, many queries: a query's answer is complete in its own row, nothing is shuffled;
* both large, words: all queries are asked for the documents of lowest ord, which are indexed; what they find there says how
  many words a later document must share, and only the rarest words of a query that such a document can't lack are joined;
* both large, vectors: the queries are a stated set, taken in blocks of bounded size against all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake import schemas
from auditlake.functions import text
from auditlake.functions.sizing import Size, measure, salted_join, sized_join
from auditlake.session import written

MAX_SIDE_BYTES = 16 << 20
MAX_SIDE_ROWS = 4_096
HEAD_ROWS = 4_096  # documents of lowest ord that all queries are asked for first
MAX_DENSE_TERMS = 1_024
_CELLS = 4_000_000  # scores held at once by a task
_ABSENT = -(1 << 40)

HIT_SCHEMA = "query_id long, ord long, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("ord", pa.int64()), ("score", pa.int64())])


def top_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row, the columns of the ``k`` best scores, best first, equal scores by column."""
    n = scores.shape[1]
    key = scores * n + np.arange(n - 1, -1, -1)  # unique, so ties are settled
    if n > k:
        chosen = np.argpartition(key, n - k, axis=1)[:, n - k:]
        key = np.take_along_axis(key, chosen, axis=1)
    else:
        chosen = np.broadcast_to(np.arange(n), scores.shape)
    return np.take_along_axis(chosen, np.argsort(-key, axis=1), axis=1)


class BestPerQuery:
    """The best ``k`` (score down, ord up) per query of the rows one task has seen."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = np.full((n_queries, 0), _ABSENT, np.int64)
        self.ords = np.zeros((n_queries, 0), np.int64)

    def add(self, scores: np.ndarray, ords: np.ndarray) -> None:
        """``scores`` is queries x rows, ``_ABSENT`` where a row does not count."""
        by_ord = np.argsort(ords)
        best = by_ord[top_columns(scores[:, by_ord], self.k)]
        merged = np.concatenate([self.scores, np.take_along_axis(scores, best, axis=1)], axis=1)
        merged_ords = np.concatenate([self.ords, ords[best]], axis=1)
        order = np.lexsort((merged_ords, -merged), axis=1)[:, : self.k]
        self.scores = np.take_along_axis(merged, order, axis=1)
        self.ords = np.take_along_axis(merged_ords, order, axis=1)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(self.scores > _ABSENT)
        return _batch(_HITS, query_ids[row], self.ords[row, col], self.scores[row, col])


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class TermIndex:
    """Words of the small side (id, words), and which of its rows hold each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.ids = table.column("id").to_numpy()
        words = pa.concat_arrays(table.column("words").chunks or [pa.array([], pa.list_(pa.string()))])
        flat = words.flatten()
        self.vocabulary = pc.unique(flat)
        terms = pc.index_in(flat, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(self.ids)), pc.list_value_length(words).to_numpy())[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(self.vocabulary) + 1))
        # Words of many rows are counted by a matrix product, the others by their postings.
        widths = np.diff(self.starts)
        dense = np.argsort(-widths, kind="stable")[:MAX_DENSE_TERMS]
        dense = dense[widths[dense] >= max(8, len(self.ids) / 64)]
        self.dense_of = np.full(len(self.vocabulary), -1)
        self.dense_of[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(self.ids)), np.float32)
        for slot, term in enumerate(dense.tolist()):
            self.dense[slot, self.rows[self.starts[term] : self.starts[term + 1]]] = 1

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        """Rows of the batch x rows of the index: number of shared words, ``_ABSENT`` for none.

        Words are taken in slices whose postings add up to no more than ``_CELLS``, so frequent words cost no memory.
        """
        n, m = part.num_rows, len(self.ids)
        words = pa.concat_arrays([part.column("words")])
        at = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())
        terms = pc.index_in(words.flatten(), value_set=self.vocabulary)
        at = at[pc.is_valid(terms).to_numpy(zero_copy_only=False)]
        terms = terms.drop_null().to_numpy().astype(np.int64)
        counts = self._dense_counts(n, at, self.dense_of[terms])
        at, terms = (x[self.dense_of[terms] < 0] for x in (at, terms))
        widths = self.starts[terms + 1] - self.starts[terms]
        slices = np.cumsum(widths) // _CELLS
        edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(terms)]
        for a, b in zip(edges, edges[1:]):
            width = widths[a:b]
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            cells = np.repeat(at[a:b], width) * m + self.rows[np.repeat(self.starts[terms[a:b]], width) + step]
            if len(cells) * 8 > n * m:
                counts += np.bincount(cells, minlength=n * m)
            elif len(cells):
                cells, many = np.unique(cells, return_counts=True)
                counts[cells] += many
        return np.where(counts > 0, counts, _ABSENT).reshape(n, m)

    def _dense_counts(self, n: int, at: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Shared words of the frequent kind, rows of the batch one behind another."""
        m = len(self.ids)
        if not len(self.dense):
            return np.zeros(n * m, np.int64)
        counts = np.empty((n, m), np.int64)
        at, slot = at[slot >= 0], slot[slot >= 0]
        step = max(1, _CELLS // len(self.dense))
        for low in range(0, n, step):
            high = min(low + step, n)
            a, b = np.searchsorted(at, [low, high])
            held = np.zeros((high - low, len(self.dense)), np.float32)
            held[at[a:b] - low, slot[a:b]] = 1
            counts[low:high] = held @ self.dense
        return counts.ravel()


class VectorIndex:
    """Unit vectors of the small side (id, vector)."""

    def __init__(self, table: pa.Table, digits: int):
        table = table.sort_by("id")
        self.ids = table.column("id").to_numpy()
        self.scale = 10**digits
        self.unit = _unit(pa.concat_arrays(table.column("vector").chunks)) if len(self.ids) else None

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        """Rows of the batch x rows of the index: cosine in units of the last digit kept."""
        if self.unit is None:
            return np.zeros((part.num_rows, 0), np.int64)
        return np.rint(_unit(pa.concat_arrays([part.column("vector")])) @ self.unit.T * self.scale).astype(np.int64)


def _unit(vectors: pa.ListArray) -> np.ndarray:
    if pc.count_distinct(pc.list_value_length(vectors)).as_py() > 1:
        raise ValueError("vectors must all have the same length")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


Index = TermIndex | VectorIndex
MakeIndex = Callable[[pa.Table], Index]


def _parts(batch: pa.RecordBatch, index: Index) -> Iterator[pa.RecordBatch]:
    rows = max(1, _CELLS // max(1, len(index.ids)))
    return (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))


def _small(size: Size, max_rows: int) -> bool:
    return size.rows <= max_rows and size.bytes <= MAX_SIDE_BYTES


def _size(df: DataFrame, max_rows: int) -> Size:
    """The size of a side; where its rows alone are too many, its bytes are not added up, nor its words worked out for it."""
    rows = df.count()
    return Size(rows, 0) if rows > max_rows else measure(df)


def _send(df: DataFrame, make: MakeIndex):
    """Index a side that was measured to be small, for all tasks; they open it with ``pickle.loads``."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(make(df.toArrow())))


def _scan_rows(rows: DataFrame, queries: DataFrame, make: MakeIndex, k: int) -> DataFrame:
    """Few queries: rows are scanned, each task leaves ``k`` hits per query."""
    sent = _send(queries, make)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        best = BestPerQuery(len(index.ids), k)
        for batch in batches:
            for part in _parts(batch, index):
                best.add(index.scores(part).T, part.column("id").to_numpy())
        yield best.batch(index.ids)

    return _merge(rows.mapInArrow(scan, HIT_SCHEMA), k)


def _scan_queries(rows: DataFrame, queries: DataFrame, make: MakeIndex, k: int) -> DataFrame:
    """Few rows: queries are scanned, and their ranks are final."""
    sent = _send(rows, make)
    schema = _HITS.append(pa.field("rank", pa.int32()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        for batch in batches:
            for part in _parts(batch, index):
                scores = index.scores(part)
                top = top_columns(scores, k)
                chosen = np.take_along_axis(scores, top, axis=1)
                row, rank = np.nonzero(chosen > _ABSENT)
                ids = part.column("id").to_numpy()
                yield _batch(schema, ids[row], index.ids[top[row, rank]], chosen[row, rank], rank + 1)

    return queries.mapInArrow(scan, HIT_SCHEMA + ", rank int")


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query of what the tasks kept, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _few_on_one_side(rows: DataFrame, queries: DataFrame, make: MakeIndex, k: int, max_rows: int) -> DataFrame | None:
    """The answer if one side is small."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if _small(_size(queries, max_rows), max_rows):
        return _scan_rows(rows, queries, make, k)
    if _small(_size(rows, max_rows), max_rows):
        return _scan_queries(rows, queries, make, k)
    return None


def _head(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows of lowest id that can be indexed and sent to all tasks, and the last id among them."""
    limit = HEAD_ROWS
    while True:
        last = rows.orderBy("id").limit(limit).agg(F.max("id")).first()[0]
        head = rows.filter(F.col("id") <= F.lit(last))
        if last is None or limit == 1 or _small(measure(head), 2 * HEAD_ROWS):
            return head, last
        limit //= 4


def _candidates(tail: DataFrame, queries: DataFrame, least: DataFrame, head: DataFrame) -> DataFrame:
    """(query_id, ord) of the later rows that may share more than ``least`` (query_id, least) words with a query.

    A row that lacks the query's n - least rarest words shares at most ``least``, so one of those must be there. Rare is what is rare
    in the head; any order would give right results.
    """
    often = head.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held"))  # as small as the head
    words = queries.join(least, F.col("id") == F.col("query_id"), "left").select(F.col("id").alias("query_id"), (F.size("words") - F.coalesce("least", F.lit(0))).alias("needed"), F.explode("words").alias("word"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("held", F.lit(0)), "word")
    asked = words.filter("needed > 0").join(F.broadcast(often), "word", "left").withColumn("nth", F.row_number().over(rarest)).filter("nth <= needed")
    asked = written(asked.select("query_id", "word"))
    held = tail.select(F.col("id").alias("ord"), F.explode("words").alias("word"))
    held = sized_join(held, asked.select("word").distinct(), ["word"], F.col("ord"), "left_semi")
    return salted_join(held, asked, ["word"], F.col("ord")).select("query_id", "ord").distinct()


def _pruned(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both sides large: exact, without the pairs that share frequent words alone.

    Of two rows with as many words the lower ord wins, so a row behind the head must share more words than the query's k-th best
    in the head.
    """
    rows, queries = written(rows), written(queries)
    head, last = _head(rows)
    if last is None:
        return _merge(rows.sparkSession.createDataFrame([], HIT_SCHEMA), k)
    first = written(_scan_queries(head, queries, TermIndex, k).drop("rank"))
    tail = rows.filter(F.col("id") > F.lit(last))
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("least"))
    pairs = written(_candidates(tail, queries, least, head))
    texts = sized_join(tail, pairs.select(F.col("ord").alias("id")).distinct(), ["id"], how="left_semi")
    both = pairs.join(texts.select(F.col("id").alias("ord"), F.col("words").alias("held")), "ord").join(queries.select(F.col("id").alias("query_id"), "words"), "query_id")
    more = both.select("query_id", "ord", F.size(F.array_intersect("held", "words")).cast("long").alias("score"))
    return _merge(first.unionByName(more), k)


def keyword_topk(docs: DataFrame, queries: DataFrame, k: int = 5, max_rows: int = MAX_SIDE_ROWS) -> DataFrame:
    """docs (ord, content) x queries (query_id, text) to (query_id, ord, overlap, rank), rank 1..k.

    Overlap counts distinct shared words; documents without any, and null texts, are left out; ties go to the lower
    ord. A side of more than ``max_rows`` rows is not sent to the tasks.
    """
    # A filter on the words themselves would work them out a second time.
    d = docs.filter(F.col("content").isNotNull()).select(F.col("ord").cast("long").alias("id"), text.words(F.col("content")).alias("words"))
    q = queries.filter(F.col("text").isNotNull()).select(F.col("query_id").cast("long").alias("id"), text.words(F.col("text")).alias("words"))
    ranked = _few_on_one_side(d, q, TermIndex, k, max_rows)
    ranked = _pruned(d, q, k) if ranked is None else ranked
    return ranked.select("query_id", "ord", F.col("score").alias("overlap"), F.col("rank").cast("int").alias("rank"))


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6, max_rows: int = MAX_SIDE_ROWS) -> DataFrame:
    """Exact: vectors (ord, vector) x queries (query_id, vector) to (query_id, ord, cosine, rank).

    Cosines are rounded to ``digits``; ties go to the lower ord. Null vectors, and those with a null in them, are left out;
    vectors of different lengths are an error.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    as_doubles = F.col("vector").cast("array<double>").alias("vector")
    v = vectors.filter(whole).select(F.col("ord").cast("long").alias("id"), as_doubles)
    q = queries.filter(whole).select(F.col("query_id").cast("long").alias("id"), as_doubles)

    def make(table: pa.Table) -> VectorIndex:
        return VectorIndex(table, digits)

    ranked = _few_on_one_side(v, q, make, k, max_rows)
    if ranked is None:
        size = measure(q)
        blocks = 2 * max(-(-size.rows // MAX_SIDE_ROWS), -(-size.bytes // MAX_SIDE_BYTES))
        for b in range(blocks):
            part = _scan_rows(v, q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), make, k)
            ranked = part if ranked is None else ranked.unionByName(part)
    cosine = (F.col("score") / F.lit(float(10**digits))).alias("cosine")
    return ranked.select("query_id", "ord", cosine, F.col("rank").cast("int").alias("rank"))


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The hit documents themselves, metadata unchanged. Few hits are sent to the documents, not the other way."""
    return sized_join(docs, hits, ["ord"])


def doc_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"))


def append_documents(docs: DataFrame, path: str) -> None:
    """Add documents (id, content, metadata) behind those stored at ``path``; ids may repeat, nothing is replaced.

    ``ord`` grows from call to call and within one by partition and row; a folder has one writer at a time.
    """
    spark = docs.sparkSession
    try:
        last = read_documents(spark, path).agg(F.max("ord")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    place = F.lit(0 if last is None else last + 1) + F.monotonically_increasing_id()
    docs.select(place.alias("ord"), *schemas.DOC.names[1:]).write.mode("append").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOC).parquet(path)


def upsert_documents(docs: DataFrame) -> DataFrame:
    """One document per id, the newest; combines before the shuffle, so many copies of one id are no load."""
    rest = [c for c in docs.columns if c != "id"]
    return docs.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("doc")).select("id", "doc.*")
