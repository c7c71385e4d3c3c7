import base64
import gzip
import hashlib
import html
import io
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from auditlake.llm import piece_sampling, token_files, warc
from auditlake.llm.piece_sampling import pieces_of, row_keys, sample_all, sampled_pieces
from auditlake.llm.warc import HEADERS, derivatives, digest, parse, plain_text, responses_of, warc_derivatives

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces_of(PATH, 1.0)


def mixed(rng):
    return "".join(rng.choice(["the ", " ", "  ", "\n", "é", "z", "▁", "un", "🙂", "\x00", "漢字", "word", "\t"]) for _ in range(rng.randrange(60)))


def test_every_text_comes_back(model):
    rng = random.Random(1)
    raw = [t.encode() for t in ["", "a", " ", "▁x▁", "a" * 300, " " * 40, *(mixed(rng) for _ in range(300))]]
    for seed in (0, 9):
        assert [model.decode(i) for i in sample_all(raw, row_keys(list(range(len(raw))), seed), model)] == raw


def test_the_library_decodes_the_same(model):
    sp = SentencePieceProcessor(model_file=PATH)
    text = "The quick brown föx jumps over 漢字 and 🙂 again"
    (ids,) = sample_all([text.encode()], row_keys([4], 0), model)
    assert sp.decode(ids.tolist()) == text


@pytest.mark.parametrize("long", [512, 1])
def test_shares_are_those_of_all_segmentations(model, monkeypatch, long):
    monkeypatch.setattr(piece_sampling, "LONG", long)
    word = b" their"
    bytes_ = set(model.byte_id.tolist())
    vocabulary = {s: i for i, s in enumerate(model.surface) if s and i not in bytes_}

    def paths(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            i = vocabulary.get(word[at:end])
            if i is not None:
                for rest, weight in paths(end):
                    yield (i, *rest), weight + model.weight[i]

    mass = {p: math.exp(w) for p, w in paths(0)}
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in sample_all([word] * n, row_keys(list(range(n)), 5), model))
    assert set(drawn) <= set(mass)
    assert max(abs(drawn[p] / n - mass[p] / sum(mass.values())) for p in mass) < 0.015


def test_long_parts_give_the_same_pieces_as_short_ones(model, monkeypatch):
    rng = random.Random(6)
    raw = [("".join(rng.choices("abcdexyz漢字水é", k=rng.randrange(1, 900)))).encode() for _ in range(30)] + [b"x" * 3000, "漢字".encode() * 700, b"<div><p>" * 300]
    keys, found = row_keys(list(range(len(raw))), 1), []
    for long in (1, 40, 10**9):
        monkeypatch.setattr(piece_sampling, "LONG", long)
        found.append(sample_all(raw, keys, model))
        assert [model.decode(i) for i in found[-1]] == raw
    assert all(np.array_equal(a, b) for other in found[1:] for a, b in zip(found[0], other))


def test_a_million_bytes_without_blanks(model):
    rng = random.Random(7)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(340_000)).encode()
    start = time.process_time()
    for text in (chinese, b"x" * 1_000_000, "".join(rng.choices("abcdefghij0123456789+/", k=1_000_000)).encode()):
        (ids,) = sample_all([text], row_keys([1], 0), model)
        assert model.decode(ids) == text
    assert time.process_time() - start < 60


def test_results_do_not_depend_on_batches(model, monkeypatch):
    rng = random.Random(2)
    raw = [mixed(rng).encode() for _ in range(40)]
    keys = row_keys(list(range(40)), 3)
    whole = sample_all(raw, keys, model)
    monkeypatch.setattr(piece_sampling, "CHUNK", 16)
    apart = [x for i in range(40) for x in sample_all(raw[i : i + 1], keys[i : i + 1], model)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, apart))
    assert any(not np.array_equal(a, b) for a, b in zip(whole, sample_all(raw, row_keys(list(range(40)), 4), model)))


def test_pieces_of_edge_rows(edge_docs, edges, no_docs, model):
    got = sampled_pieces(edge_docs, PATH).collect()
    keys = row_keys([i for i, _ in edges], 0)
    want = []
    for (i, t), ids in zip(edges, sample_all([(t or "").encode() for _, t in edges], keys, model)):
        raw = (t or "").encode()
        want.append((i, len(raw), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(raw), True, ids.tolist()))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert sampled_pieces(no_docs, PATH).collect() == []


def test_plain_text_is_what_can_be_seen():
    page = "<!DOCTYPE html><head><title>T</title></head><body><style>p{}</style><script>var t='</p>';</script><!-- no --><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree</p>\n<ul><li>x<li>y &lt;z&gt;</ul></body>"
    assert plain_text(page) == "A & B\none\ntwo three\nx\ny <z>"
    assert plain_text("") == "" and plain_text("<p") == "" and plain_text("a < b") == "a < b" and plain_text("<script>x") == ""


def test_a_head_without_its_end_hides_no_text():
    assert plain_text("<html><head><title>T</title><p>text of <b>it</b><p>more") == "text of it\nmore"
    assert plain_text("<head lang=en>\n<META charset=x><link rel=a><title>T <p></title><style>p{}</style><!-- <p> --><script>'<p>'</script>text") == "text"
    assert plain_text("<head><title>T</title><body class=b>one</body>") == "one" and plain_text("<head><title>T</title></head>one") == "one"
    assert plain_text("<head><title>T<meta></head><body>one") == "one" and plain_text("<head><script>x</head><body>one") == "one"
    assert plain_text("<head><title>T</title>") == "" and plain_text("<head><meta") == "" and plain_text("<header>h</header>") == "h"


def test_records_link_and_verify():
    raw = derivatives(7, "http://a/", "2020-01-01T00:00:00Z", 404, HEADERS + "\nX-A: b", "<p>hi")
    (meta, block), (conv, text) = parse(b"".join(map(gzip.compress, raw)))
    assert meta["warc-refers-to"] == conv["warc-refers-to"] and meta["warc-record-id"] != conv["warc-record-id"]
    assert text == b"hi" and conv["warc-block-digest"] == digest(b"hi") and conv["warc-source-payload-digest"] == digest(b"<p>hi")
    fields = block.decode()
    assert f"source-payload-digest: {digest(b'<p>hi')}" in fields and "source-header: X-A: b" in fields and f"derived-conversion: {conv['warc-record-id']}" in fields
    assert meta["warc-target-uri"] == "http://a/" and meta["warc-date"] == "2020-01-01T00:00:00Z"
    spoilt = bytearray(raw[1])
    spoilt[spoilt.rindex(b"hi")] = 0
    with pytest.raises(ValueError):
        list(parse(gzip.compress(bytes(spoilt))))
    with pytest.raises(ValueError):
        list(parse(gzip.compress(raw[0])[:-20]))


PAGES = [(1, "http://a/1", "<p>one &eacute;</p>"), (2, None, "<p>two"), (3, "http://a/3", None), (4, "http://a/4", ""), (None, "http://a/5", "<p>x</p>" * 5000), (1, "http://a/1", "<p>one &eacute;</p>"), (6, "bad\r\nurl", "plain é 🙂")]


def test_derivatives_of_edge_rows(spark):
    pages = spark.createDataFrame([(*p, f"k{i}", "n") for i, p in enumerate(PAGES)], "page_id long, url string, html string, key string, name string").repartition(3)
    rows = warc_derivatives(responses_of(pages)).collect()
    assert len(rows) == 2 * len(PAGES)
    got = sorted(repr((r["key"], r["block"])) for r in rows if r["record_type"] == "conversion")
    assert got == sorted(repr((None if i is None else str(i), plain_text(h or ""))) for i, _, h in PAGES)
    by_source = Counter(r["refers_to"] for r in rows)
    assert sorted(by_source.values()) == [2] * 5 + [4]
    for r in rows:
        block = r["block"].encode()
        assert r["content_length"] == len(block) and r["block_digest"] == digest(block)
    assert hashlib.sha1(html.unescape("é").encode()).hexdigest()


def test_identifiers_of_the_source_are_kept(spark):
    columns = "key string, target_uri string, date string, status int, headers string, payload string, record_id string, block_digest string, payload_digest string, reason string"
    rows = [
        ("1", "http://a/", "2021-02-03T04:05:06Z", 404, "Content-Type: text/html\nServer: s", "<p>no</p>", "<urn:uuid:0f>", "sha1:BLOCK", "sha256:PAYLOAD", "Nothing Here"),
        ("2", "http://b/", None, 503, "", "<p>b</p>", None, None, None, None),
    ]
    got = {(r["key"], r["record_type"]): r for r in warc_derivatives(spark.createDataFrame(rows, columns)).collect()}
    for kind in ("metadata", "conversion"):
        assert got["1", kind]["refers_to"] == "<urn:uuid:0f>" and got["1", kind]["source_payload_digest"] == "sha256:PAYLOAD"
    block = got["1", "metadata"]["block"]
    for line in ("source-record-id: <urn:uuid:0f>", "source-block-digest: sha1:BLOCK", "source-payload-digest: sha256:PAYLOAD", "source-http-status: 404", "source-http-reason: Nothing Here", "source-header: Server: s"):
        assert line in block.split("\r\n")
    assert "source-http-reason: Service Unavailable" in got["2", "metadata"]["block"]
    http = b"HTTP/1.1 503 Service Unavailable\r\nContent-Length: 8\r\n\r\n<p>b</p>"
    assert "source-block-digest: sha1:" + base64.b32encode(hashlib.sha1(http).digest()).decode() in got["2", "metadata"]["block"]


def second_reader(raw):
    """Records of a file, read by the format's rules alone: gzip members, header lines, a block of the stated length."""
    for member in gzip.GzipFile(fileobj=io.BytesIO(raw)).read().split(b"WARC/1.1\r\n")[1:]:
        lines, _, rest = member.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in lines.decode().split("\r\n"))
        yield headers, rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]


def test_files_as_another_reader_sees_them(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_derivatives(responses_of(pages), str(tmp_path / "out"))
    found = [r for f in (tmp_path / "out/files").glob("*.warc.gz") for r in second_reader(f.read_bytes())]
    assert len(found) == 2 * len(PAGES) and all(end == b"\r\n\r\n" for *_, end in found)
    ids = Counter(h["WARC-Record-ID"] for h, *_ in found)
    for headers, block, _ in found:
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if headers["WARC-Type"] == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
            assert fields["source-record-id"] == headers["WARC-Refers-To"] and fields["derived-conversion"] in ids
        else:
            assert headers["WARC-Type"] == "conversion" and headers["Content-Type"] == "text/plain; charset=utf-8"
    texts = Counter(block.decode() for h, block, _ in found if h["WARC-Type"] == "conversion")
    assert texts == Counter({"one é": 2, "two": 1, "": 2, "\n".join(["x"] * 5000): 1, "plain é 🙂": 1})


@pytest.mark.parametrize("module", [warc, token_files])
def test_files_go_to_the_default_file_system(spark, tmp_path, monkeypatch, module):
    """A folder without a scheme is where the session's default file system says, for tasks and for readers."""
    monkeypatch.setattr(module, "qualified", lambda _, folder: f"file:{tmp_path}/default{folder}")
    docs = spark.createDataFrame([(i, f"<p>text {i}") for i in range(20)], "page_id long, html string")
    if module is warc:
        manifest = warc.write_derivatives(responses_of(docs.withColumn("url", docs.html)), "/out")
    else:
        manifest = token_files.write_tokens(docs.withColumnsRenamed({"page_id": "doc_id", "html": "text"}), public_tokenizers.path("byte_bpe_50k.json"), "/out")
    names = {r["name"] for r in manifest.collect()}
    assert names and names == {f.name for f in (tmp_path / "default/out/files").iterdir() if not f.name.startswith(".")}


def test_derivatives_of_no_rows(spark):
    assert warc_derivatives(responses_of(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
