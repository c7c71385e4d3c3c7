"""What the operators of this folder share: reading tables, cutting lineage, and small Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.session import shared_dir

BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: no lineage, any executor can read them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    for noted in _RECORDING:
        noted.append(back)
    return back


_RECORDING: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """What is stored within, to be released once nothing that was made of it is read any more."""
    steps: list[DataFrame] = []
    _RECORDING.append(steps)
    try:
        yield steps
    finally:
        _RECORDING.remove(steps)


def release(*steps: DataFrame) -> None:
    """Delete the files of ``stored`` rows that nothing reads any more; rows that were not stored are left alone."""
    for df in steps:
        if path := getattr(df, "stored_at", None):
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there.getParent(), True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches sent to Python by rows and bytes, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_batches(df: DataFrame, make: Callable[[dict], dict], schema: str, fields: pa.Schema) -> DataFrame:
    """``make`` turns the columns of each Arrow batch (name to Arrow array) into the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in fields], schema=fields)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
