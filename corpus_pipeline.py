"""The corpus pipeline: documents through five stages, each written and read again as the next one's input.

Every stage but the last returns the columns of ``documents`` with its decisions taken; the last returns one row per
document that is left, with its sampled pieces. No stage can be written in SQL as a whole, so there is no ORACLE_SQL; the
tests compare each with a brute-force version.

What a stage has stored for itself is deleted when the next one begins, so a stage's result must be written before that, as
``run`` does. Verdicts go by row, not by ``doc_id``: where rows must be named, by their place in the files they are read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.sizing import fits
from auditlake.llm.common import recorded, release, stored, table
from auditlake.llm.decontaminate import contamination
from auditlake.llm.near_duplicates import later_keys
from auditlake.llm.piece_sampling import sampled_pieces
from auditlake.llm.quality_rules import quality
from auditlake.llm.queries import PIECES
from auditlake.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
KEY = "row_key"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last: list[DataFrame] = []


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*_last)
        with recorded() as steps:
            result = work(spark, docs, sf_dir)
        _last[:] = steps
        return result

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, as ids may be null or repeated: the hash of the file's path and the row's number in it.

    Rows that do not come straight from files are stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs.select(*COLUMNS))
    return docs.select(*COLUMNS, F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index")).alias(KEY))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among ``keys``, sent to all tasks if they were measured to be few."""
    keys = stored(keys.select(KEY))
    return keyed.join(F.broadcast(keys) if fits(keys) else keys, KEY, "left_anti").select(*COLUMNS)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted quality rules keep. Null and empty texts, and others of fewer than 20 words, go; no rows give
    no rows; rows of equal or null ids are judged one by one."""
    return quality(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8): the one of the smallest id, nulls last; of rows equal in id and
    text any one. Null texts and texts without words are like nothing and stay; no rows give no rows."""
    keyed = _keyed(docs)
    return _without(keyed, later_keys(keyed, KEY))


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that start earlier, and their new lengths; null becomes empty. All rows stay,
    in a repeated row nothing is left; no rows give no rows."""
    cut = remove_repeats(docs, with_kept=True)
    return cut.select(F.col("row.doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Null and empty texts have none and stay; no rows give no rows."""
    keyed = _keyed(docs)
    return _without(keyed, contamination(keyed, table(spark, sf_dir, "benchmark"), key=KEY).where("contaminated"))


@_stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, and whether they decode to it. Null and empty texts have no pieces; no rows give no rows."""
    return sampled_pieces(docs, public_tokenizers.path(PIECES))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
