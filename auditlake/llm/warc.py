"""WARC derivatives: each response gives a metadata record and a plain-text conversion record, both linked to it.

A response is a row (key, target_uri, date, status, headers, payload), and where its record is known also record_id,
block_digest, payload_digest and reason; these are kept as they are. Only what is missing is built: an id from the
response's content, digests from a block of status line, headers and payload. The files hold the derivatives. Both name the
response in WARC-Refers-To and repeat its target, date and payload digest; the metadata record's fields hold the source's
status line, headers and digests and name the conversion. Ids made here are version-5 UUIDs of the source's id, so a repeated task
writes the same records. Every
record is a gzip member of its own. Files are written by the tasks to the shared folder and named in a manifest that Spark
commits, then read back by Spark, with every digest and length verified.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches
from auditlake.session import shared_dir
from auditlake.sources.files import open_folder, qualified

FILE_BYTES = 16 << 20
READ = 1 << 12  # bytes; most records take one or two
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
DATE = "1970-01-01T00:00:00Z"
OWN = ("record_id", "block_digest", "payload_digest", "reason")
HEADERS = "Content-Type: text/html; charset=utf-8"

# A head goes on as long as tags follow that can stand in it, and ends there if </head> is left out. One of its elements
# that is never closed ends before </head> or <body>.
_HEAD = r"""<head\b[^>]*(?:>|\Z)(?:\s+|<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)
|<(?P<raw>title|script|style|template|noscript|noframes)\b[^>]*(?:>|\Z)(?:.*?</(?P=raw)\s*>|.*?(?=</head\b|<body\b)|.*)
|<(?:meta|link|base|basefont|bgsound|html|head)\b[^>]*(?:>|\Z)|</(?!(?:head|body|html|br)\b)[a-z][^>]*(?:>|\Z))*+(?:</head\b[^>]*(?:>|\Z))?""".replace("\n", "")
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|" + _HEAD, re.I | re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_SPACES = re.compile(r"[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]")  # all but single blanks, the most frequent


def plain_text(page: str) -> str:
    """The visible text: one line per block, entities decoded, no markup, spaces folded."""
    text = _DROP.sub(" ", page)
    text = _TAG.sub("", _BLOCK.sub("\n", text.replace("\n", " ")))
    lines = _SPACES.sub(" ", html.unescape(text)).split("\n")
    return "\n".join(line for line in (x.strip(" ") for x in lines) if line).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def clean(value) -> str:
    """A header's value: one line."""
    line = str(value)
    return (re.sub(r"[\r\n]+[ \t]*", " ", line) if "\n" in line or "\r" in line else line).strip()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join('' if p is None else str(p) for p in parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The uncompressed bytes of one record."""
    lines = [*headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def reason_of(status) -> str:
    try:
        return HTTPStatus(int(status)).phrase
    except ValueError:
        return ""


def derivatives(key, uri, date, status, headers: str | None, payload: str | None, own_id: str | None = None, own_block: str | None = None, own_payload: str | None = None, reason: str | None = None) -> list[bytes]:
    """The metadata and the conversion record of one response; ``own_...`` and ``reason`` are its record's, if known."""
    status = status or 200
    reason = reason_of(status) if reason is None else clean(reason)
    body = (payload or "").encode("utf-8", "surrogatepass")
    fields = [line for line in (headers or "").splitlines() if line.strip()]
    http = (f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{clean(f)}\r\n" for f in fields) + f"Content-Length: {len(body)}\r\n\r\n").encode()
    source_block, source_payload, date = own_block or digest(http + body), own_payload or digest(body), date or DATE
    source = own_id or record_id("response", key, uri, date, source_block)
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    text = plain_text(payload or "").encode("utf-8", "surrogatepass")
    about = [
        ("source-record-id", source), ("source-block-digest", source_block), ("source-payload-digest", source_payload),
        ("source-http-status", status), ("source-http-reason", reason), *[("source-header", f) for f in fields], ("source-content-length", len(http) + len(body)),
        ("derived-conversion", text_id), ("derived-block-digest", digest(text)), ("row-key", "" if key is None else key),
    ]
    block = "".join(f"{k}: {clean(v)}\r\n" for k, v in about).encode()
    uri_header = [] if not uri else [("WARC-Target-URI", uri)]

    def head(kind: str, own: str, mime: str, content: bytes) -> list[tuple[str, str]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *uri_header, ("WARC-Date", date), ("WARC-Source-Payload-Digest", source_payload), ("WARC-Block-Digest", digest(content)), ("Content-Type", mime)]

    return [record(head("metadata", meta_id, "application/warc-fields", block), block), record(head("conversion", text_id, "text/plain; charset=utf-8", text), text)]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = open_folder(folder)
    store.create_dir(root)
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(b"".join(held))
        return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([len(held)], pa.int64())})

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            members = [gzip.compress(r, 1, mtime=0) for r in derivatives(*row)]
            held += members
            size += sum(map(len, members))
            if size >= FILE_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def write_derivatives(responses: DataFrame, folder: str) -> DataFrame:
    """Write the derivatives of (key, target_uri, date, status, headers, payload) rows, the columns ``OWN`` kept where there are such;
    returns the stored manifest."""
    spark = responses.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)  # tasks and Spark's own readers must mean the same place
    own = [(F.col(c) if c in responses.columns else F.lit(None)).cast("string").alias(c) for c in OWN]
    made = responses.select(*[F.col(c).cast("string") for c in ("key", "target_uri", "date", "status", "headers", "payload")], *own)
    made.mapInArrow(partial(_write, folder=f"{folder}/files"), "name string, n_records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("name string, n_records long").parquet(f"{folder}/manifest")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each gzip member; raises where a length or digest is wrong."""
    at, view = 0, memoryview(content)
    while at < len(content):
        member = zlib.decompressobj(31)
        parts = []
        while not member.eof:
            if at >= len(content):
                raise ValueError("a record is cut off")
            parts.append(member.decompress(view[at : at + READ]))
            at += READ
        at = min(at, len(content)) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        length = int(headers["content-length"])
        block = rest[:length]
        if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n" or digest(block) != headers["warc-block-digest"]:
            raise ValueError(f"a record is damaged: {headers.get('warc-record-id')}")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            key = None
            for headers, block in parse(content.as_py()):
                if headers["warc-type"] == "metadata":
                    fields = dict(line.partition(": ")[::2] for line in block.decode().split("\r\n") if not line.startswith("source-header"))
                    key = fields["row-key"] or None
                rows.append((key, headers["warc-type"], headers["warc-record-id"], headers["warc-refers-to"], headers.get("warc-target-uri"), headers["warc-date"], headers["content-type"], len(block), headers["warc-block-digest"], headers["warc-source-payload-digest"], block.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)


RECORDS = pa.schema([(c, pa.int64() if c == "content_length" else pa.string()) for c in ("key", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "block")])
RECORD_COLUMNS = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in RECORDS)


def read_derivatives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the files that the manifest names; raises if a file is damaged."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/files")
    named = files.select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    small_batches(spark, rows=1)
    return named.join(manifest.select("name"), "name", "left_semi").select("content").mapInArrow(_read, RECORD_COLUMNS)


def responses_of(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Raw pages as responses: the url is the target, the html the payload; the table has no date, so the default holds."""
    return pages.select(
        F.col("page_id").cast("string").alias("key"), F.col("url").alias("target_uri"), (F.lit(DATE) if date is None else date).alias("date"),
        F.lit(200).alias("status"), F.lit(HEADERS).alias("headers"), F.col("html").alias("payload"),
    )


def warc_derivatives(responses: DataFrame) -> DataFrame:
    """All derivative records, written to the shared folder and read back.

    A null payload is an empty one and gives an empty conversion; a null target leaves its header out; a null key
    stays null; a null status is 200, a null date the default, a null reason the status's usual one, and a null id or digest is built. Equal rows give equal records, one pair for each row. An
    empty table gives no rows. Other columns are not read.
    """
    spark = responses.sparkSession
    folder = shared_dir(spark)
    manifest = write_derivatives(responses, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_COLUMNS)
    return read_derivatives(spark, folder, manifest)
