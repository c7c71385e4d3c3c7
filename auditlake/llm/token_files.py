"""Token ids in files of frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A file holds the ids of a range of rows. It begins with its own rank table (ids by falling frequency in the file, ties by
id), so a reader needs nothing else. Rank r takes 1 byte if r < 256, 2 if r < 65536, else 4. The lengths stand apart
from the bytes, in control bytes: 1 bit per id (8 ids a byte) if no rank needs 4 bytes, else 2 bits (4 ids a byte).
Decoding looks each control byte up in a 256-row table of lengths, so numpy finds all starts with one running sum.

Layout, little-endian: MAGIC, u32 bits per length, u32 ranks R, u32 rows D, u64 ids N, u64 data bytes B; u32 ids[R] by rank;
i64 row ids[D] and a null flag u8[D]; u32 ids per row[D]; control bytes; data bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import BATCH_BYTES, small_batches
from auditlake.llm.units import check_tokenizer, ids_of, tokenizer, unit_cache
from auditlake.session import shared_dir
from auditlake.sources.files import open_folder, qualified

MAGIC = b"RANKVB01"
TEXT_BYTES_PER_FILE = 16 << 20
MAX_IDS_PER_FILE = 1 << 24


SLICE = 1 << 20


def ranks_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by rank, rank by id): by falling count, ties by id."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    by_rank = used[np.argsort(-counts[used], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    return by_rank.astype("<u4"), rank_of


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, int, bytes, bytes]:
    """(ids by rank, bits per length, control bytes, data bytes)."""
    by_rank, rank_of = ranks_of(ids)
    bits = 2 if len(by_rank) > 1 << 16 else 1
    controls, datas = [], []
    for at in range(0, len(ids), SLICE):  # a multiple of 8, so control bytes of slices follow each other
        ranks = rank_of[ids[at : at + SLICE]]
        code = (ranks > 0xFF).astype(np.uint8)
        if bits == 2:
            code += 2 * (ranks > 0xFFFF).astype(np.uint8)
            padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
            padded[: len(code)] = code
            controls.append((padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes())
        else:
            controls.append(np.packbits(code, bitorder="little").tobytes())
        starts = np.cumsum(code, dtype=np.int64) + np.arange(len(code)) - code
        data = np.zeros(int(starts[-1]) + int(code[-1]) + 1, np.uint8)
        data[starts] = ranks.astype(np.uint8)
        for k in range(1, 4 if bits == 2 else 2):
            wide = np.flatnonzero(code >= k)
            data[starts[wide] + k] = (ranks[wide] >> np.uint32(8 * k)).astype(np.uint8)
        datas.append(data.tobytes())
    return by_rank, bits, b"".join(controls), b"".join(datas)


@lru_cache(maxsize=2)
def lengths_table(bits: int) -> np.ndarray:
    """For each control byte the lengths of its ids."""
    return 1 + ((np.arange(256)[:, None] >> (bits * np.arange(8 // bits))) & ((1 << bits) - 1)).astype(np.uint8)


def decode_ids(by_rank: np.ndarray, bits: int, n: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    ids, begin, each = np.empty(n, "<u4"), 0, SLICE * bits // 8
    for at in range(0, n, SLICE):
        widths = lengths_table(bits)[control[at // SLICE * each : at // SLICE * each + each]].reshape(-1)[: n - at]
        starts = np.cumsum(widths, dtype=np.int64) - widths + begin
        ranks = data[starts].astype(np.uint32)
        for k in range(1, 4 if bits == 2 else 2):
            wide = np.flatnonzero(widths > k)
            ranks[wide] |= data[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
        ids[at : at + SLICE] = by_rank[ranks]
        begin = int(starts[-1]) + int(widths[-1])
    return ids


def pack(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """The bytes of one file."""
    every = np.concatenate(ids)
    by_rank, bits, control, data = encode_ids(every)
    head = np.array([bits, len(by_rank), len(doc_ids)], "<u4").tobytes() + np.array([len(every), len(data)], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, by_rank.tobytes(), keys, np.array([len(x) for x in ids], "<u4").tobytes(), control, data])


def unpack(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(row ids, ids per row, all ids) of one file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    bits, r, d = np.frombuffer(content, "<u4", 3, 8).tolist()
    n, b = np.frombuffer(content, "<u8", 2, 20).tolist()
    at = 36
    by_rank = np.frombuffer(content, "<u4", r, at)
    keys = np.frombuffer(content, "<i8", d, at := at + 4 * r).tolist()
    null = np.frombuffer(content, np.uint8, d, at := at + 8 * d)
    sizes = np.frombuffer(content, "<u4", d, at := at + d)
    n_control = -(-n * bits // 8)
    control = np.frombuffer(content, np.uint8, n_control, at := at + 4 * d)
    data = np.frombuffer(content, np.uint8, b, at + n_control)
    return [None if x else k for k, x in zip(keys, null.tolist())], sizes, decode_ids(by_rank, bits, n, control, data)


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes the files of one partition, whose rows come in order, and returns a row for each file."""
    from pyspark import TaskContext

    store, root = open_folder(folder)
    store.create_dir(root)
    narrow = tokenizer(path).get_vocab_size() <= 1 << 16
    cache = unit_cache(path, "H" if narrow else "I")
    kind = "<u2" if narrow else "<u4"
    end = np.array([end_id], kind)
    part, seq = TaskContext.get().partitionId(), 0
    doc_ids: list = []
    ids: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.tokens"  # a repeated task writes its own; the manifest names one
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(pack(doc_ids, ids))
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_pydict({"name": [name], "part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [held]}, schema=MANIFEST)

    for batch in batches:
        got, at = ids_of(*cache.batch(batch.column(1)), kind)
        for doc_id, s, e in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            if ids and held + e - s + 1 > MAX_IDS_PER_FILE:
                yield flush()
                doc_ids, ids, held, seq = [], [], 0, seq + 1
            doc_ids.append(doc_id)
            ids.append(np.append(got[s:e], end))
            held += e - s + 1
    if ids:
        yield flush()


MANIFEST = pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the ids in ascending doc_id order; returns the stored manifest.

    Rows are range-partitioned by (doc_id, hash of the text), so a repeated id is spread; null ids come first, a null
    text has the end id alone. ``folder`` must be one that all executors share. Each file is written under a new
    name and named in the manifest only by the attempt that Spark commits, so lost executors and repeated tasks leave
    orphans but no wrong rows. An empty table gives an empty manifest.
    """
    check_tokenizer(path)
    spark = docs.sparkSession
    folder = qualified(spark, folder)  # tasks and Spark's own readers must mean the same place
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        files = max(spark.sparkContext.defaultParallelism, -(-size // TEXT_BYTES_PER_FILE))
    small_batches(spark, rows=8192, size=BATCH_BYTES // 2)
    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = ordered.mapInArrow(partial(_write, path=path, folder=f"{folder}/files", end_id=end_id), "name string, part int, seq int, n_docs long, n_ids long")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.schema("name string, part int, seq int, n_docs long, n_ids long").parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit_cache.cache_clear()  # what a reused worker holds from writing
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
            keys, sizes, ids = unpack(content.as_py())
            ends = np.cumsum(sizes, dtype=np.int64)
            starts = ends - sizes
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"name": [name] * len(keys), "doc_id": pa.array(keys, pa.int64()), "start": starts, "n_tokens": sizes.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: each is read by Spark and decoded in one task.

    Where a file's ids begin comes from the manifest, one row per file, joined to the decoded rows.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("name", F.coalesce(before, F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(f"{folder}/files")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    small_batches(spark, rows=1)
    decoded = named.mapInArrow(_read, "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return decoded.join(bases, "name").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all texts to the shared folder and read them back; see ``write_tokens`` and ``read_tokens``."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    manifest = write_tokens(docs, path, folder, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, manifest)
