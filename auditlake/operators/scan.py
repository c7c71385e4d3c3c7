"""Scans of files, folders and inline code: line rules and syntax-tree rules together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.rules import LINE_RULES, LineRule
from auditlake.operators.code_scan import line_findings
from auditlake.operators.syntax import ast_findings
from auditlake.schemas import FILE
from auditlake.session import written
from auditlake.sources.files import read_one, read_tree

SNIPPET = "<snippet>"


def scan(files: DataFrame, rule_rows: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """All findings of files (path, content). Each kind of rule reads the files once: store what is slow to read."""
    return line_findings(files, rule_rows).unionByName(ast_findings(files))


def scan_snippets(snippets: DataFrame, rule_rows: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Inline code (content, optional path) to findings of both kinds; a missing name becomes ``<snippet>``."""
    name = F.coalesce(F.col("path"), F.lit(SNIPPET)) if "path" in snippets.columns else F.lit(SNIPPET)
    return scan(snippets.select(name.alias("path"), "content"), rule_rows)


def scan_source(
    spark: SparkSession, code: str | None = None, path: str | None = None, name: str | None = None,
    is_file: bool = False, rule_rows: Sequence[LineRule] = LINE_RULES,
) -> DataFrame:
    """Inline code, which wins, or else a folder or one file. Other files than ``.py`` give no findings.

    A folder is listed and read once; both kinds of rule read what was stored.
    """
    if code:
        return scan(spark.createDataFrame([(name or SNIPPET, code)], FILE), rule_rows)
    if not path:
        raise ValueError("give code or a path")
    return scan(read_one(spark, path) if is_file else written(read_tree(spark, path)), rule_rows)
