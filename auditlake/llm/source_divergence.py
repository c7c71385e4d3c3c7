"""Source divergence audit: how the words of each source differ from its language's other sources and from the whole language.

Inside ``mapInArrow`` a batch goes through Arrow's compute functions alone: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode``, and two hash ``group_by``s, by (document, term) and by (lang, source, term). A task merges its batches'
counts and hands them on when they reach PARTIAL_ROWS, so a source with a third of all rows costs no more than a row per term and
task. Spark adds them up to cells (lang, source, term, n, docs).

A language keeps the terms that occur in at least ``least_docs`` of its documents, V of them. In a group with N occurrences of
kept terms, a term with n has the share p = 1 + floor(10^9 (n + 5) / (N + 5 V)); N, V and products are exact decimals. The distance
of two sources is the sum of |p_a - p_b| over all V terms. A term that neither has adds |z_a - z_b|, where z is the share of
n = 0; so only the cells are dealt out, to columnar shards by (lang, block of sources, block of sources, slice of terms), each of
which spreads TERMS_AT_ONCE terms at a time to a dense matrix. No shard holds more than about CELLS_PER_SHARD cells
times the two blocks' share, however many sources and terms a language has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.sizing import sized_join
from auditlake.llm.common import small_batches, stored

NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
PARTIAL_ROWS = 400_000
SOURCES_PER_BLOCK = 512
CELLS_PER_SHARD = 200_000
TERMS_AT_ONCE = 2048
_KEY = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (lang, source, text)."""
    terms = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=NOT_LETTERS)
    each = pc.list_flatten(terms).dictionary_encode()
    codes = {c: batch.column(c).dictionary_encode() for c in ("lang", "source")}
    found = pa.table({"row": pc.list_parent_indices(terms), "term": each.indices})
    none = pc.index(each.dictionary, "").as_py()  # what stands before, between and behind separators
    if none >= 0:
        found = found.filter(pc.not_equal(found.column("term"), pa.scalar(none, pa.int32())))
    by_row = found.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    coded = pa.table({**{c: codes[c].indices.take(by_row.column("row")) for c in codes}, "term": by_row.column("term"), "n": by_row.column("count_all")})
    counted = coded.group_by(_KEY, use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    names = {**{c: codes[c].dictionary for c in codes}, "term": each.dictionary}
    return pa.table([*[names[c].take(counted.column(c)) for c in _KEY], counted.column("n_sum"), counted.column("n_count")], schema=_COUNTS)


def _merged(parts: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(parts).group_by(_KEY, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([both.column(c) for c in (*_KEY, "n_sum", "docs_sum")], schema=_COUNTS)


def _partial(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch_counts(batch))
        rows += parts[-1].num_rows
        if rows > most:
            parts = [_merged(parts)]
            rows = parts[0].num_rows
            if rows > most // 2:
                yield from parts[0].to_batches(65_536)
                parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(65_536)


_DISTANCE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _distances(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Both directions of each pair of sources in a shard: (at, term, p) of the terms there, and (at, source, zero, v, block, shard) of
    the sources of its one or two blocks."""
    order = pc.sort_indices(sources, sort_keys=[("at", "ascending")])
    sources = sources.take(order)
    at, zero, block = (sources.column(c).to_numpy() for c in ("at", "zero", "block"))
    apart = np.abs(zero[:, None] - zero[None, :])
    total = apart * (sources.column("v")[0].as_py() if sources.column("shard")[0].as_py() == 0 else 0)
    if cells.num_rows:
        term = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        place, p = np.searchsorted(at, cells.column("at").to_numpy()), cells.column("p").to_numpy()
        by_term = np.argsort(term, kind="stable")
        term, place, p = term[by_term], place[by_term], p[by_term]
        n = int(term[-1]) + 1
        for low in range(0, n, TERMS_AT_ONCE):
            high = min(low + TERMS_AT_ONCE, n)
            own = slice(*np.searchsorted(term, [low, high]))
            shares = np.tile(zero, (high - low, 1))
            shares[term[own] - low, place[own]] = p[own]
            for a in range(len(at)):
                total[a] += np.abs(shares[:, a : a + 1] - shares).sum(axis=0)
        total -= apart * n
    # Two blocks give the pairs between them; those within one are of its own shard.
    wanted = block[:, None] != block[None, :] if block[0] != block[-1] else ~np.eye(len(at), dtype=bool)
    a, b = np.nonzero(wanted)
    names = sources.column("source").combine_chunks()
    return pa.table([pa.array([sources.column("lang")[0].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[a, b])], schema=_DISTANCE)


def _share(n: str, of: str, v: str) -> Column:
    """1 + floor(10^9 (n + 5) / (of + 5 v)); null where v is 0."""
    return F.expr(f"IF({v} > 0, 1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 5 AS DECIMAL(20, 0))) DIV CAST({of} + 5 * {v} AS DECIMAL(20, 0)), NULL)")


def _shards(frame: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its block is in."""
    other = frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, partial_rows: int = PARTIAL_ROWS, cells_per_shard: int = CELLS_PER_SHARD, sources_per_block: int = SOURCES_PER_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module for the shares.

    Part ``pair``: for every other source of the language its distance, all ranks. Part ``term``: the ``top`` terms that the group has
    and whose share in the group exceeds that in the language, by the difference. Ranks go by falling value, then by the item's
    bytes. A null text, lang or source is the empty one; a group without terms has pairs all the same; a language that keeps no
    term has distances of 0; a language's only source has no pairs. Repeated rows are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    none = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(c) for c in ("lang", "source", "text")])
    small_batches(docs.sparkSession)
    counts = rows.mapInArrow(partial(_partial, most=partial_rows), "lang string, source string, term string, n long, docs long")
    cells = stored(counts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).where(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "lang_n", "sources"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_of"), F.sum("sources").alias("cells"))
    cells = stored(cells.drop("docs").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    every = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_of", "cells", "of"])
    in_lang = Window.partitionBy("lang")
    block = F.floor(F.col("at") / sources_per_block).cast("int")
    groups = every.withColumn("at", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("block", block)
    groups = groups.withColumns({"blocks": F.max("block").over(in_lang) + 1, "shards": F.ceil(F.greatest("cells", F.lit(1)) / cells_per_shard).cast("int"), "zero": F.coalesce(_share("0", "of", "v"), F.lit(0)).cast("long")})
    groups = stored(groups.select("lang", "source", "v", "lang_of", "of", F.col("at").cast("long").alias("at"), "block", "blocks", "shards", "zero"))
    shares = sized_join(cells, groups, ["lang", "source"], F.col("term")).withColumn("p", _share("n", "of", "v"))
    shares = stored(shares.withColumn("q", _share("lang_n", "lang_of", "v")))
    # Pairs: the cells and the sources of a shard meet there.
    dealt = _shards(shares.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "block", "blocks", "at", "term", "p"))
    named = _shards(groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))).select("lang", "shard", "low", "high", "block", "at", "source", "zero", "v")
    key = ["lang", "low", "high", "shard"]
    parts = dealt.select(*key, "at", "term", "p").groupBy(*key).cogroup(named.groupBy(*key)).applyInArrow(_distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", "part", "item", "value", F.row_number().over(by_value).alias("rank"))
    best = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return ranked.unionByName(best)
