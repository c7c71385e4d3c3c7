"""Prompt sources: intake with defaults and rejects, and bulk load of labelled prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.sources.json_array import read_array, write_arrays

DEFAULT_AUTHOR, DEFAULT_BRANCH = "anonymous", "main"


def or_default(col: Column, default: str) -> Column:
    """Null and empty both take the default."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def accept(prompts: DataFrame) -> DataFrame:
    """Prompts that have the required fields, author and branch filled in. Works on streams."""
    return prompts.filter(F.col("prompt").isNotNull() & F.col("project_id").isNotNull()).withColumns(
        {"author": or_default(F.col("author"), DEFAULT_AUTHOR), "branch": or_default(F.col("branch"), DEFAULT_BRANCH)}
    )


def reject(prompts: DataFrame) -> DataFrame:
    """The others, with the name of the first missing field."""
    missing = F.when(F.col("prompt").isNull(), "prompt").when(F.col("project_id").isNull(), "project_id")
    return prompts.withColumn("missing_field", missing).filter(F.col("missing_field").isNotNull())


def read_labelled(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Labelled requests ``{label, request}``: files that hold one array each, or one object per line.

    Array files are read by many tasks, however large each is.
    """
    raw = spark.read.schema(schemas.LABELLED_PROMPT).json(path) if json_lines else read_array(spark, path, schemas.LABELLED_PROMPT)
    return raw.select("label", "request.*")


def write_labelled(labelled: DataFrame, path: str, json_lines: bool = True) -> None:
    """One JSON object per line, or files of one array each."""
    rows = labelled.select("label", F.struct("prompt", "project_id", "author", "branch").alias("request"))
    rows.write.json(path) if json_lines else write_arrays(rows, path)
