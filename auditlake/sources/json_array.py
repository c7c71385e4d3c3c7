"""Records of JSON array files of any size, each file read by many tasks.

A file is cut into ranges of bytes. Whether a range begins inside a string, and how deep, is not known from its own bytes; but
an unescaped quote flips the first wherever it stands, so each range is summed up for both cases in one pass, and a running
sum over the few sums of a file tells every range where it begins. In a second pass each range hands out the objects that begin
in it at the array's own level, reading on behind its end for the last of them. Escapes are settled by the backslashes just
before a range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.session import written
from auditlake.sources.files import open_folder, qualified

RANGE_BYTES = 32 << 20
READ_ON = 1 << 20
_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that begin or end a string; ``escaped``: an odd number of backslashes stands before the data."""
    slash = data == _BACKSLASH
    at = np.flatnonzero(data == _QUOTE)
    # Backslashes right before each quote: its place less the last other byte's before it.
    others = np.where(slash, -1, np.arange(len(data)))
    last = np.maximum.accumulate(others) if len(data) else others
    before = np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
    run = at - 1 - before + (escaped & (before < 0))
    return at[run % 2 == 0]


def _inside(data: np.ndarray, escaped: bool, inside: bool) -> np.ndarray:
    """Whether each byte lies in a string, quotes at its begin included."""
    flips = np.zeros(len(data), np.int8)
    flips[quotes(data, escaped)] = 1
    return (np.cumsum(flips) + inside) % 2 == 1


def summary(data: np.ndarray, escaped: bool) -> tuple[bool, int, int]:
    """(odd number of quotes, change of depth if the data begin outside a string, and inside one)."""
    within, step = _inside(data, escaped, False), _STEP[data]
    return bool(len(quotes(data, escaped)) % 2), int(step[~within].sum(dtype=np.int64)), int(step[within].sum(dtype=np.int64))


def records(data: np.ndarray, escaped: bool, inside: bool, depth: int) -> tuple[list[tuple[int, int]], int | None]:
    """((begin, end) of the objects of the outer array that begin and end here, begin of one that doesn't end)."""
    step = np.where(_inside(data, escaped, inside), 0, _STEP[data])
    after = depth + np.cumsum(step, dtype=np.int64)
    begins = np.flatnonzero((step > 0) & (after == 2) & (data == ord("{")))
    ends = np.flatnonzero((step < 0) & (after == 1) & (data == ord("}")))
    places = np.searchsorted(ends, begins)
    whole = places < len(ends)
    return list(zip(begins[whole].tolist(), (ends[places[whole]] + 1).tolist())), int(begins[~whole][0]) if (~whole).any() else None


def _open(path: str):
    folder, _, name = path.rpartition("/")
    store, base = open_folder(folder)
    return store.open_input_file(f"{base}/{name}")


def _escaped(file, at: int) -> bool:
    """Whether an odd number of backslashes stands right before the place."""
    n = 0
    while at > 0:
        size = min(at, 4096)
        file.seek(at - size)
        block = file.read(size)
        run = size - len(block.rstrip(b"\\"))
        n, at = n + run, at - size
        if run < size:
            break
    return n % 2 == 1


def _ranges(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["file"]) as file:
                escaped = _escaped(file, row["at"])
                file.seek(row["at"])
                yield from make(row, file, np.frombuffer(file.read(row["size"]), np.uint8), escaped)


_SUMS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("odd", pa.bool_()), ("out", pa.int64()), ("within", pa.int64())])
_RECORDS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("record", pa.binary())])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(row, _, data, escaped):
        odd, out, within = summary(data, escaped)
        yield pa.RecordBatch.from_pylist([{**row, "odd": odd, "out": out, "within": within}], schema=_SUMS)

    return _ranges(batches, make)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(row, file, data, escaped):
        found, open_ = records(data, escaped, row["inside"], row["depth"])
        raw = data.tobytes()
        rows = [{"file": row["file"], "at": row["at"] + a, "record": raw[a:b]} for a, b in found]
        if open_ is not None:  # the last object goes on behind the range
            held = raw[open_:]
            while more := file.read(READ_ON):
                held += more
                ended, _ = records(np.frombuffer(held, np.uint8), False, False, 1)
                if ended:
                    rows.append({"file": row["file"], "at": row["at"] + open_, "record": held[: ended[0][1]]})
                    break
            else:
                raise ValueError(f"{row['file']}: the object at byte {row['at'] + open_} does not end")
        for low in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist(rows[low : low + 1024], schema=_RECORDS)

    return _ranges(batches, make)


def read_records(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, at, record) of the objects in the array files at ``path``, a file or a folder of files; ``at`` is their first byte.

    Files without objects give no rows. An object without end is an error, a record that is not UTF-8 is null.
    """
    size = range_bytes or RANGE_BYTES
    there = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(s.getPath().toString(), s.getLen()) for s in store.listStatus(there) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    listed = spark.createDataFrame(files, "file string, length long").filter("length > 0")
    ranges = listed.select("file", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("long"), F.lit(size))).alias("at"), "length")
    ranges = ranges.select("file", F.col("at").cast("long").alias("at"), F.least(F.lit(size), F.col("length") - F.col("at")).cast("long").alias("size"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = ranges.repartition(tasks, "file", "at")
    sums = written(spread.mapInArrow(_sum, "file string, at long, size long, odd boolean, out long, within long"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    state = sums.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    state = state.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("out")))
    state = state.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    known = written(state.select("file", "at", "size", "inside", "depth"))
    found = known.repartition(tasks, "file", "at").mapInArrow(_cut, "file string, at long, record binary")
    return found.withColumn("record", F.try_validate_utf8(F.col("record").cast("string")))


def read_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int | None = None) -> DataFrame:
    """The objects as rows of ``schema``; what is no JSON of that form is null."""
    found = read_records(spark, path, range_bytes)
    return found.select(F.from_json("record", schema).alias("row")).select("row.*")


def write_arrays(rows: DataFrame, path: str) -> None:
    """One array file per partition, named in no order; a repeated task writes a file of the same name."""
    root = qualified(rows.sparkSession, path)
    job = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_folder(root)
        store.create_dir(base)
        n = 0
        with store.open_output_stream(f"{base}/part-{job}-{TaskContext.get().partitionId():05d}.json", compression=None) as out:
            out.write(b"[")
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    out.write((b",\n" if n else b"\n") + record.encode())
                    n += 1
            out.write(b"\n]\n")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("record")).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
