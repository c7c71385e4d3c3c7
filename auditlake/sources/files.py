"""Source trees as tables. ``files`` everywhere means (path, content), content null when not UTF-8.

Spark's own file sources leave out names that start with ``_`` or ``.``, so ``__init__.py``, ``.env`` and
ignore files would be missing. Folders are therefore listed, and files read, inside tasks through
Arrow's file systems (local, HDFS, S3 ...), folder by folder, skipped folders never entered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.rules import SKIP_DIRS

_LIST_ROUNDS = 3
_LIST_ROWS = 4096
_BATCH_BYTES = 16 << 20


def ends_with_any(path: Column, suffixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes])


def not_skipped(path: Column, skip_dirs: Sequence[str] = SKIP_DIRS) -> Column:
    """No component of the path, relative to its root, is a skipped name."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in skip_dirs]))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """The file name's suffix, as in ``a.py``; a name like ``.py`` has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"[^.].*(\.[^.]+)\z", 1).isin(list(extensions))


def source_files(files: DataFrame, extensions: Sequence[str] = (".py",), skip_dirs: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """The files of a tree that a scan reads."""
    path = F.col("path")
    return files.filter(not_skipped(path, skip_dirs) & has_extension(path, extensions))


def open_folder(root: str):
    """(file system, path) of a folder given as a local path or a URI such as ``hdfs://`` or ``file:/``."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    filesystem, base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    return filesystem, base.rstrip("/")


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as a URI: without a scheme it is on the session's default file system, for tasks as for the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _tasks(spark: SparkSession) -> int:
    """Tasks for work on files: a fixed number, because paths are too few bytes for Spark to judge it by."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _lister(root: str, skip: frozenset[str], recursive: bool):
    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("is_dir", pa.bool_())])

    def children(filesystem, base: str, folder: str) -> Iterator[dict]:
        for info in filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            if info.base_name in skip:
                continue
            path = f"{folder}/{info.base_name}".lstrip("/")
            is_dir = info.type == fs.FileType.Directory
            if is_dir and isinstance(filesystem, fs.LocalFileSystem) and os.path.islink(info.path):
                continue  # a linked folder is listed where it is, or lies outside the tree
            if is_dir and recursive:
                yield from children(filesystem, base, path)
            else:
                yield {"path": path, "is_dir": is_dir}

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_folder(root)
        for batch in batches:
            for path, is_dir in zip(batch.column("path").to_pylist(), batch.column("is_dir").to_pylist(), strict=True):
                found = children(filesystem, base, path) if is_dir else iter([{"path": path, "is_dir": False}])
                while rows := list(islice(found, _LIST_ROWS)):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return expand


def list_tree(spark: SparkSession, root: str, skip_dirs: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """(path): every file below ``root``, relative to it. Each round lists one level, spread by path."""
    root = qualified(spark, root)
    level = spark.createDataFrame([("", True)], "path string, is_dir boolean")
    for i in range(_LIST_ROUNDS):
        last = i == _LIST_ROUNDS - 1
        spread = level if i == 0 else level.repartition(spark.sparkContext.defaultParallelism, "path")
        level = spread.mapInArrow(_lister(root, frozenset(skip_dirs), last), "path string, is_dir boolean")
    return level.select("path")


def _reader(root: str):
    schema = pa.schema([("path", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_folder(root)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                data, error = None, None
                try:
                    with filesystem.open_input_file(f"{base}/{path}") as handle:
                        data = handle.read()
                except OSError as exc:  # gone since it was listed, or not to be read: a row, not a failed job
                    error = type(exc).__name__
                rows.append({"path": path, "bytes": data, "error": error})
                held += len(data or b"")
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_files(paths: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """(path, content, error) of listed files. What can't be read or is not UTF-8 has a null content and an error.

    A task hands on its files in small batches, so few tasks cost time, not memory.
    """
    root = qualified(paths.sparkSession, root)
    spread = paths.select("path").repartition(tasks or _tasks(paths.sparkSession), "path")
    raw = spread.mapInArrow(_reader(root), "path string, bytes binary, error string")
    content = F.try_validate_utf8(F.col("bytes").cast("string"))
    undecoded = F.when(content.isNull(), F.lit("UnicodeDecodeError"))
    return raw.select("path", content.alias("content"), F.coalesce("error", undecoded).alias("error"))


def read_tree(
    spark: SparkSession, root: str, extensions: Sequence[str] = (".py",), skip_dirs: Sequence[str] = SKIP_DIRS
) -> DataFrame:
    """The files below ``root`` that a scan reads; names are filtered before anything is opened."""
    return read_files(source_files(list_tree(spark, root, skip_dirs), extensions, skip_dirs), root)


def read_one(spark: SparkSession, path: str, extensions: Sequence[str] = (".py",)) -> DataFrame:
    """One file under its full path; a missing one, or one of another kind, gives no row."""
    folder, _, name = path.rpartition("/")
    root = qualified(spark, folder or "/")
    schema = pa.schema([("path", pa.string()), ("is_dir", pa.bool_())])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, base = open_folder(root)
        for batch in batches:
            rows = [
                {"path": p, "is_dir": False} for p in batch.column("path").to_pylist()
                if filesystem.get_file_info(f"{base}/{p}").type == fs.FileType.File
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    named = spark.createDataFrame([(name, False)], "path string, is_dir boolean")
    found = named.filter(has_extension(F.col("path"), extensions)).mapInArrow(present, "path string, is_dir boolean")
    return read_files(found, folder or "/").select(F.lit(path).alias("path"), "content", "error")


def read_config_tree(spark: SparkSession, root: str, suffixes: Sequence[str], skip_dirs: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """The files below ``root`` whose name ends with one of ``suffixes``, ``.env`` itself included."""
    listed = list_tree(spark, root, skip_dirs)
    return read_files(listed.filter(ends_with_any(F.col("path"), suffixes)), root)


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content) as files below ``root``; a repeated task writes the same bytes again."""
    root = qualified(files.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_folder(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{path}"
                filesystem.create_dir(os.path.dirname(target), recursive=True)
                with filesystem.open_output_stream(target) as out:
                    out.write(content.encode())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def delete_files(files: DataFrame, root: str) -> None:
    """Delete the files (path) below ``root``; one that is gone already is no error."""
    root = qualified(files.sparkSession, root)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, base = open_folder(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if filesystem.get_file_info(f"{base}/{path}").type == fs.FileType.File:
                    filesystem.delete_file(f"{base}/{path}")
            yield batch

    files.select("path").mapInArrow(delete, "path string").write.format("noop").mode("overwrite").save()
