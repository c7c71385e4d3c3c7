"""A folder as a stream of edits: every file once as it is, then again whenever its time or size changes, and once when it is gone.

Names that start with ``_`` or ``.`` are seen like any other; skipped folders are not entered. The offset is the number of a
listing (path, time, size); listings are kept as files in ``state``, a folder that driver and tasks share, so a restarted stream
goes on where it was and an offset stays a number however many files there are. The driver lists, as Spark's own file
stream does; files are read in tasks, some MB each. A file that is edited while its batch runs comes again in the next one.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from auditlake.functions.rules import SKIP_DIRS
from auditlake.sources.files import open_folder, qualified

NAME = "edited_files"
SCHEMA = "path string, content string, error string, deleted boolean"
_BATCH = pa.schema([("path", pa.string()), ("content", pa.string()), ("error", pa.string()), ("deleted", pa.bool_())])
TASK_BYTES = 32 << 20
TASK_FILES = 4_096
Listing = dict[str, tuple[int, int]]


@dataclass
class Files(InputPartition):
    changed: list[str]
    gone: list[str]


class EditedFiles(DataSource):
    """Options: ``root``, ``state``, ``extensions`` and ``skip`` joined by commas, ``paths_per_batch``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EditReader(self.options["root"], self.options["state"], self.options.get("extensions", ""), self.options.get("skip", ""))


class EditReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, extensions: str, skip: str):
        self.root, self.state = root, state
        self.extensions = tuple(e for e in extensions.split(",") if e)
        self.skip = frozenset(s for s in skip.split(",") if s)

    def _list(self) -> Listing:
        from pyarrow import fs

        store, base = open_folder(self.root)
        found: Listing = {}
        open_folders = [""]
        while open_folders:
            folder = open_folders.pop()
            for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                path = f"{folder}/{info.base_name}".lstrip("/")
                if info.type == fs.FileType.Directory and info.base_name not in self.skip:
                    open_folders.append(path)
                elif info.type == fs.FileType.File and (not self.extensions or info.base_name.lstrip(".").find(".") >= 0 and info.base_name.endswith(self.extensions)):
                    found[path] = (info.mtime_ns or 0, info.size or 0)
        return found

    def _load(self, n: int) -> Listing:
        if n == 0:
            return {}
        store, base = open_folder(self.state)
        with store.open_input_file(f"{base}/{n}.json.gz") as f:
            return {p: (t, s) for p, t, s in json.loads(gzip.decompress(f.read()))}

    def _newest(self) -> int:
        from pyarrow import fs

        store, base = open_folder(self.state)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return max((int(n.removesuffix(".json.gz")) for n in names if n.endswith(".json.gz") and n[0].isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the newest listing, a new one if something changed since."""
        n, now = self._newest(), self._list()
        if now != self._load(n):
            n += 1
            store, base = open_folder(self.state)
            store.create_dir(base)
            with store.open_output_stream(f"{base}/.{n}", compression=None) as out:
                out.write(gzip.compress(json.dumps([(p, *v) for p, v in sorted(now.items())]).encode()))
            store.move(f"{base}/.{n}", f"{base}/{n}.json.gz")  # whole or not there
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = self._load(start["listing"]), self._load(end["listing"])
        changed = sorted(p for p, v in after.items() if before.get(p) != v)
        gone = sorted(before.keys() - after.keys())
        parts, held, size = [], [], 0
        for path in changed:
            held.append(path)
            size += after[path][1]
            if size >= TASK_BYTES or len(held) >= TASK_FILES:
                parts.append(Files(held, []))
                held, size = [], 0
        if held:
            parts.append(Files(held, []))
        parts += [Files([], gone[i : i + TASK_FILES]) for i in range(0, len(gone), TASK_FILES)]
        return parts or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(self.root)
        rows: list[dict] = []
        for path in partition.changed:
            content, error = None, None
            try:
                with store.open_input_file(f"{base}/{path}") as f:
                    content = f.read().decode()
            except (OSError, UnicodeDecodeError) as exc:  # gone again, or no text: a row, not a failed batch
                error = type(exc).__name__
            rows.append({"path": path, "content": content, "error": error, "deleted": False})
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, schema=_BATCH)
                rows = []
        rows += [{"path": p, "content": None, "error": None, "deleted": True} for p in partition.gone]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BATCH)

    def commit(self, end: dict) -> None:
        """Older listings are not asked for again."""
        from pyarrow import fs

        store, base = open_folder(self.state)
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = info.base_name.removesuffix(".json.gz")
            if name.isdigit() and int(name) < end["listing"] - 1:
                store.delete_file(info.path)


def watch_tree(spark: SparkSession, root: str, state: str, extensions: Sequence[str] = (".py",), skip_dirs: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """The stream (path, content, error, deleted) of the edits below ``root``; ``state`` belongs to this stream alone."""
    spark.dataSource.register(EditedFiles)
    reader = spark.readStream.format(NAME).option("root", qualified(spark, root)).option("state", qualified(spark, state))
    return reader.option("extensions", ",".join(extensions)).option("skip", ",".join(skip_dirs)).load()
