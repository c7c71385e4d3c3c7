"""Requirement lines to dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.rules import UNPINNED


def parse(lines: DataFrame) -> DataFrame:
    """(project_id, line_no, line) to (project_id, line_no, name, version); blanks and comments dropped.

    The first ``==`` splits name and version; a line without one is its own name, and unpinned.
    """
    stripped = lines.select("project_id", "line_no", text.strip(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#")
    )
    parts = F.split("line", "==", 2)
    pinned = F.col("line").contains("==")
    return stripped.select(
        "project_id", "line_no",
        F.when(pinned, text.strip(F.get(parts, F.lit(0)))).otherwise(F.col("line")).alias("name"),
        F.when(pinned, text.strip(F.get(parts, F.lit(1)))).otherwise(UNPINNED).alias("version"),
    )


def latest(dependencies: DataFrame) -> DataFrame:
    """One version per project and name: the last line wins. Combines before the shuffle."""
    return dependencies.groupBy("project_id", "name").agg(F.max_by("version", "line_no").alias("version"))


def read_lines(files: DataFrame, project_of) -> DataFrame:
    """Root requirements files (path, content) to numbered lines; ``project_of`` maps the path column."""
    from auditlake.operators.code_scan import file_lines

    return file_lines(files).select(project_of(F.col("path")).alias("project_id"), "line_no", "line")
