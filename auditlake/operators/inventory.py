"""Codebase inventory: endpoints, models, pinned dependencies and a checksum per project.

The facts stay flat tables, so a project that holds most of the code is never gathered into one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.registry import Registry
from auditlake.operators.syntax import syntax_facts
from auditlake.sources import requirements


def inventory_facts(files: DataFrame) -> DataFrame:
    """Endpoint and model facts from one pass; only files that can hold either leave the JVM."""
    content = F.col("content")
    endpoints = content.contains("@") & content.contains("def")
    models = content.contains("class") & content.contains("(")
    return syntax_facts(files.filter(endpoints | models), findings=False).filter("kind <> 'error'")


def _order() -> Column:
    """Modules by their path, and within one by walk order: never the same for two facts."""
    return F.struct(F.col("path").alias("module"), F.col("seq").cast("long").alias("seq"))


def endpoints_of(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'endpoint'").select(
        _order().alias("ord"), F.col("name").alias("path"), F.col("detail").alias("method"), "handler",
        F.col("path").alias("module"), "parameters", F.lit("Any").alias("return_type"),
    )


def models_of(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'model'").select(_order().alias("ord"), "name", F.col("path").alias("module"))


def build_registry(files: DataFrame, requirement_lines: DataFrame, project_of: Callable[[Column], Column]) -> Registry:
    """The registry that prompt audits use, read from the projects' own code."""
    facts = inventory_facts(files)
    project = project_of(F.col("module")).alias("project_id")
    return Registry(
        endpoints_of(facts).select(project, "*"),
        models_of(facts).select(project, "*"),
        requirements.latest(requirements.parse(requirement_lines)),
    )


def snapshot(registry: Registry) -> DataFrame:
    """The context as rows (project_id, kind, name, value), repeated facts kept."""
    return (
        registry.endpoints.select(
            "project_id", F.lit("endpoint").alias("kind"), F.col("path").alias("name"),
            F.concat_ws(" ", "method", "handler", "module", F.array_join("parameters", ",")).alias("value"),
        )
        .unionByName(registry.models.select(
            "project_id", F.lit("model").alias("kind"), "name", F.lit("").alias("value")))
        .unionByName(registry.dependencies.select(
            "project_id", F.lit("dependency").alias("kind"), "name", F.col("version").alias("value")))
    )


def context_summary(snapshot_rows: DataFrame) -> DataFrame:
    """Counts and a 12-digit checksum per project.

    The checksum adds up a 60-bit hash of every fact, so it needs no order and no gathered group, and
    changes when a fact is added, removed, repeated or edited.
    """
    digest = F.sha2(F.concat_ws("\x1f", "kind", "name", "value"), 256)
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    sums = snapshot_rows.select("project_id", "kind", part.alias("part")).groupBy("project_id").agg(
        F.count_if(F.col("kind") == "endpoint").alias("n_endpoints"),
        F.count_if(F.col("kind") == "model").alias("n_models"),
        F.count_if(F.col("kind") == "dependency").alias("n_dependencies"),
        F.sum("part").alias("total"),
    )
    checksum = F.substring(F.sha2(F.concat_ws(":", F.col("total").cast("string"), "project_id"), 256), 1, 12)
    return sums.select("project_id", "n_endpoints", "n_models", "n_dependencies", checksum.alias("checksum"))


def write_snapshot(snapshot_rows: DataFrame, path: str) -> None:
    """JSON lines, one folder per project."""
    snapshot_rows.write.partitionBy("project_id").json(path)
