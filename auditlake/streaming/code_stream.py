"""Source files scanned as they are written and edited."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from auditlake.functions.rules import LINE_RULES, LineRule
from auditlake.operators.scan import scan
from auditlake.schemas import FINDING
from auditlake.session import remove, written

BATCH = "batch_id"


def scan_stream(files: DataFrame, rule_rows: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """A stream of (path, content) to a stream of findings of both kinds; stateless."""
    return scan(files, rule_rows)


def write_findings(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once parquet sink."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def scan_edits(edits: DataFrame, path: str, checkpoint: str, rule_rows: Sequence[LineRule] = LINE_RULES) -> DataStreamWriter:
    """A stream of edits (path, content, error, deleted) to a folder of findings by batch, beside it which files each batch saw.

    A batch that is run again replaces its own folders.
    """

    def store(batch: DataFrame, n: int) -> None:
        held = written(batch)  # read once: a file may be edited again meanwhile
        scan(held.filter("content is not null").select("path", "content"), rule_rows).write.mode("overwrite").parquet(f"{path}/findings/{BATCH}={n}")
        held.select("path", "deleted").write.mode("overwrite").parquet(f"{path}/seen/{BATCH}={n}")
        remove(held)

    return edits.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of every file as it was last seen; deleted files have none."""
    try:
        seen = spark.read.schema(f"path string, deleted boolean, {BATCH} long").parquet(f"{path}/seen")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDING)
    last = seen.groupBy(F.col("path").alias("file")).agg(F.max(BATCH).alias(BATCH))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FINDING.fields)
    findings = spark.read.schema(f"{columns}, {BATCH} long").parquet(f"{path}/findings")
    return findings.join(last, ["file", BATCH]).select(FINDING.names)
