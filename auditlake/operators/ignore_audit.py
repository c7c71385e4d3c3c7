"""Ignore files: which required patterns are there, and which secret files are exposed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rules import IGNORE_ADVICE, IGNORE_OK, REQUIRED_IGNORES
from auditlake.operators.ignore_rules import compiled, ignored_paths, matches


def _sample(required: str) -> tuple[str, bool]:
    """A path below some folder that the required pattern is meant for, and whether it is a folder."""
    return "any/" + required.rstrip("/").replace("*", "sample"), required.endswith("/")


def audit_ignores(
    roots: DataFrame, ignore_lines: DataFrame, required: Sequence[str] = REQUIRED_IGNORES
) -> DataFrame:
    """One report per root. A required pattern is present if the last line that says something of a path of its kind ignores it,
    so broader globs count and a later negation takes it back. Lines of a root are combined before the shuffle.
    """
    rules = compiled(ignore_lines)
    decisions = []
    for i, pattern in enumerate(required):
        name, is_folder = _sample(pattern)
        says = matches(f"'{name}'", F.lit(is_folder)) | matches("'any'", F.lit(True))
        decisions.append(F.max_by(~F.col("negated"), F.when(says, F.col("line_no"))).alias(f"need_{i}"))
    reports = rules.groupBy("root").agg(*decisions) if decisions else rules.select("root").distinct()
    kept = [F.when(F.col(f"need_{i}"), F.lit(p)) for i, p in enumerate(required)]
    reports = reports.select("root", F.array_compact(F.array(*kept).cast("array<string>")).alias("entries"))
    # A file without any rule is there all the same.
    found = ignore_lines.select("root", F.lit(True).alias("found")).distinct()
    reports = found.join(reports, "root", "left")
    joined = roots.select("root").distinct().join(reports, "root", "left")
    listed = F.coalesce(F.col("entries"), F.array().cast("array<string>"))
    need = F.array(*[F.lit(p) for p in required])
    present = F.filter(need, lambda p: F.array_contains(listed, p))
    return joined.select(
        "root", F.coalesce("found", F.lit(False)).alias("gitignore_found"), present.alias("present_patterns"),
        F.array_except(need, present).alias("missing_patterns"),
    ).select(
        "root", "gitignore_found", (F.size("missing_patterns") == 0).alias("is_sufficient"),
        "present_patterns", "missing_patterns",
        F.when(F.size("missing_patterns") > 0, IGNORE_ADVICE).otherwise(IGNORE_OK).alias("recommendation"),
    )


def exposed_env(files: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """``.env`` files (root, path) that the rules of their root do not ignore."""
    env = files.filter(F.element_at(F.split("path", "/"), -1) == ".env").select("root", "path")
    return env.join(ignored_paths(env, ignore_lines), ["root", "path"], "left_anti")


def rollup(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Findings per root next to the root's ignore report."""
    counts = findings.groupBy("root").agg(
        F.count("*").alias("n_findings"), F.array_sort(F.collect_set("type")).alias("types")
    )
    return reports.join(counts, "root", "left").fillna(0, ["n_findings"]).withColumn(
        "types", F.coalesce("types", F.array().cast("array<string>"))
    )
