"""Token counts of whole texts. Huge texts are encoded in overlapping chunks that are spliced where both agree.

Splicing is exact, not a guess. A chunk's tokens are those of the whole text from a start that is a true boundary
between pre-tokens up to MARGIN characters before the chunk's end, because a pre-token's end depends on no more than the
character behind it, or on an added token's string, which is shorter than MARGIN. The next chunk starts anywhere in the
overlap, perhaps inside a word. At a position where both chunks end a pre-token, the pattern starts afresh on the same
text, so all later tokens of the next chunk are those of the whole text. If the overlap holds no such position, it is
widened; if it reaches back to the chunk's start, the chunk itself is lengthened, at last to the whole rest.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import map_batches
from auditlake.llm.units import MAX_ADDED, check_tokenizer, tokenizer, unit_cache

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
MARGIN = MAX_ADDED


def encode_chunk(path: str, text: str) -> tuple[int, dict[int, int]]:
    """The number of tokens, and for each pre-token's end that is not white space the tokens before it."""
    enc = tokenizer(path).encode(text, add_special_tokens=False)
    words, offsets = enc.word_ids, enc.offsets
    ends = {}
    for i in range(len(words) - 1):
        if words[i] != words[i + 1] and offsets[i][1] > offsets[i][0] and not text[offsets[i][1] - 1].isspace():
            ends[offsets[i][1]] = i + 1
    return len(words), ends


def count_in_chunks(path: str, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of the whole text, holding the encodings of two chunks at a time."""
    counted, start, size = 0, 0, chunk
    first = 0  # tokens of the current chunk that are not of the whole text
    n, ends = encode_chunk(path, text[: start + size])
    while start + size < len(text):
        stop, back, spliced = start + size, overlap, False
        while not spliced and stop - back > start:
            at = stop - back
            m, later = encode_chunk(path, text[at : at + chunk + back])
            common = [e for e in ends if at < start + e <= stop - MARGIN and ends[e] >= first and start + e - at in later]
            if common:
                e = max(common)
                counted += ends[e] - first
                first, n, ends, start, size = later[start + e - at], m, later, at, chunk + back
                spliced = True
            back *= 2
        if not spliced:
            size *= 2
            n, ends = encode_chunk(path, text[start : start + size])
    return counted + n - first


def _counts(columns: dict, path: str, chunk: int, overlap: int) -> dict:
    texts = columns["text"]
    huge = np.flatnonzero(pc.greater(pc.utf8_length(texts).fill_null(0), chunk).to_numpy(zero_copy_only=False))
    results, places, bounds = unit_cache(path, "count").batch(pc.if_else(pc.greater(pc.utf8_length(texts), chunk), "", texts))
    counts = np.diff(np.concatenate([[0], np.cumsum(np.array(results, np.int64)[places])])[bounds])
    for i in huge.tolist():
        counts[i] = count_in_chunks(path, texts[i].as_py(), chunk, overlap)
    return {"doc_id": columns["doc_id"], "n_bytes": columns["n_bytes"], "n_tokens": counts}


def token_counts(docs: DataFrame, path: str, doc_id: Column | None = None, text: Column | None = None, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``, in one narrow pass.

    A null text counts as empty: no bytes, no tokens. Null and repeated ids stay as they are, one row each. Other
    columns are not read, whatever their names. Strings of added tokens inside a text count as the library's
    default has it. The tokenizer's pattern must start afresh behind each pre-token, as byte-level ones do; others are refused.
    """
    check_tokenizer(path)
    text = (F.col("text") if text is None else text).cast("string")
    rows = docs.select((F.col("doc_id") if doc_id is None else doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes"), text.alias("text"))
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    counted = map_batches(rows, partial(_counts, path=path, chunk=chunk, overlap=overlap), "doc_id long, n_bytes long, n_tokens long", fields)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
