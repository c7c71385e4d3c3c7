"""Prompts audited as they arrive, with the same columns as the batch audit.

A log folder holds ``writer=<name>/batch_id=<n>/audit_date=<day>``. The name is made once and kept in the checkpoint, so streams
that share a log, or one that lost its checkpoint, never write over each other; a batch that is run again replaces its own folder alone.

An id is logged once. Ids that arrived within ``remember`` are known to the state store, and their audits are not even worked
out again. Of all others the index of ids says which folders could hold them, and only those are read; none that it rules out.
Nothing is ever too late, as the state goes by time of arrival.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from auditlake.functions.rules import PROMPT_RULES
from auditlake.operators import audit_log, id_index
from auditlake.operators.conflict_runs import packed
from auditlake.operators.prompt_rules import Rule
from auditlake.operators.registry import Registry
from auditlake.operators.verdict import audit_id_of, audit_prompts, row_keyed
from auditlake.session import remove, written
from auditlake.sources.prompts import accept

REMEMBER = "1 day"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ID_ROWS = T.StructType([f for f in audit_log.LOG_SCHEMA.fields if f.name == "audit_id"])


def writer_name(spark: SparkSession, checkpoint: str) -> str:
    """The stream's name, made when its checkpoint is first used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "writer")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        out = store.create(path, False)  # fails if another start was faster
        try:
            out.writeUTF(uuid.uuid4().hex)
        finally:
            out.close()
    file = store.open(path)
    try:
        return file.readUTF()
    finally:
        file.close()


def _once(rows: DataFrame, remember: str) -> DataFrame:
    """The rows whose audit_id has not arrived within ``remember``, by a state store that keeps ids that long."""
    spark = rows.sparkSession
    if spark.conf.get(_STORE).endswith("HDFSBackedStateStoreProvider"):  # Spark's default keeps all ids on the heap
        spark.conf.set(_STORE, _ROCKS)
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return arrived.dropDuplicatesWithinWatermark(["audit_id"]).drop("_arrived")


def folders_that_may_hold(spark: SparkSession, path: str, ids: DataFrame, but: tuple[str, int] | None = None) -> list[str]:
    """The log's folders that may hold any of the ids (audit_id), without those of one batch of a writer."""
    index = id_index.read(spark, path)
    if index is None:
        return []
    found = id_index.places(index, ids).collect()  # folders, not rows
    paths = [f"{path}/writer={r['writer']}/batch_id={r['batch_id']}/{audit_log.DAY}={r['audit_date']}" for r in found if (r["writer"], r["batch_id"]) != but]
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    store = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(p for p in paths if store.exists(jpath(p)))  # an index may stand without its batch if that failed


def _store_new(audits: DataFrame, path: str, writer: str, batch_id: int, session: SparkSession | None = None) -> None:
    """Store the audits whose id no other batch holds, each once. A batch that is run again replaces its first try.

    ``session`` does the work once the batch is stored: a stream with state has a session of its own without adaptive execution,
    in which skewed joins are not split and every task would write a file for each day.
    """
    spark = session or audits.sparkSession
    held = written(audit_log.log_rows(audit_log.first_per_id(packed(audits))), spark)  # worked out once, and once stamped
    fresh = held
    if folders := folders_that_may_hold(spark, path, held, (writer, batch_id)):
        known = spark.read.schema(_ID_ROWS).parquet(*folders)
        fresh = audit_log.not_held(held, held.select("audit_id"), known)
    # The index comes first: what is in the log is always in the index.
    id_index.write(fresh, path, writer, batch_id)
    audit_log.append(fresh, f"{path}/writer={writer}/batch_id={batch_id}", mode="overwrite")
    remove(held)


def append_to_log(audits: DataFrame, path: str, checkpoint: str, remember: str = REMEMBER) -> DataStreamWriter:
    """Writer of a stream of audits into a log folder: one row per audit id, however late and in whatever batch its audits arrive.

    Of several audits of one id that arrive within ``remember`` one is kept.
    """
    spark = audits.sparkSession
    writer = writer_name(spark, checkpoint)
    stream = _once(audits, remember).writeStream
    return stream.foreachBatch(lambda batch, n: _store_new(batch, path, writer, n, spark)).option("checkpointLocation", checkpoint)


def audit_each_batch(
    prompts: DataFrame, registry: Registry, path: str, checkpoint: str, rule_rows: Sequence[Rule] = PROMPT_RULES, remember: str = REMEMBER
) -> DataStreamWriter:
    """A stream of prompts to a log of audits, for registries of any size: measured once, joined per micro-batch."""
    spark = prompts.sparkSession
    fold, writer = registry.can_fold(), writer_name(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = written(row_keyed(batch), spark)
        _store_new(audit_prompts(arrived, registry, rule_rows, fold, packed=True), path, writer, batch_id)
        remove(arrived)

    named = accept(prompts).withColumn("audit_id", audit_id_of())
    return _once(named, remember).drop("audit_id").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What all batches of all writers wrote."""
    return audit_log.read(spark, path).select(audit_log.LOG_SCHEMA.names)


def get_audits(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The audits of all wanted ids (audit_id); folders that hold none of them are not opened."""
    folders = folders_that_may_hold(spark, path, wanted)
    if not folders:
        return spark.createDataFrame([], audit_log.LOG_SCHEMA)
    log = spark.read.schema(audit_log.LOG_SCHEMA).option("basePath", path).parquet(*folders)
    return audit_log.get_audits(log.select(audit_log.LOG_SCHEMA.names), wanted)
