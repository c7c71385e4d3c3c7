import json
import random

import numpy as np
import pytest

from auditlake.sources.json_array import quotes, read_array, read_records, write_arrays
from auditlake.sources.prompts import read_labelled

PARTS = ["{", "}", "[", "]", '"', "\\", "\\\\", '\\"', "é", "漢字", ",", ":", "\n", "plain text", " ", '{"x": "y"}', "\\\\\\"]


def objects(n, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        made.append({"id": i, "text": text, "more": [{"a": text}, [1, {"b": "]}"}]] if i % 3 else {}})
    return made


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_objects(spark, tmp_path, size):
    rows = objects(25 if size == 1 else 80)
    for k, (part, options) in enumerate([(rows[::2], {}), (rows[1::2], {"indent": 2, "ensure_ascii": False})]):
        (tmp_path / f"{k}.json").write_text(json.dumps(part, **options), encoding="utf-8")
    got = [json.loads(r["record"]) for r in read_records(spark, str(tmp_path), size).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


def test_a_file_alone_empty_files_and_places(spark, tmp_path):
    text = '[ {"x": 1} , 5, [ {"y": 2} ], "{", {"x": 2}]'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "none.json").write_text("")
    (tmp_path / "nothing.json").write_text(" [ ] \n")
    got = read_records(spark, str(tmp_path / "a.json"), 5).collect()
    assert sorted((r["at"], r["record"]) for r in got) == [(2, '{"x": 1}'), (text.index('{"x": 2}'), '{"x": 2}')]
    assert read_records(spark, str(tmp_path / "none.json")).count() == 0 and read_records(spark, str(tmp_path / "nothing.json"), 2).count() == 0
    (tmp_path / "cut.json").write_text('[{"x": 1}, {"x": ')
    with pytest.raises(Exception, match="does not end"):
        read_records(spark, str(tmp_path / "cut.json")).collect()


def test_equal_to_the_whole_file_reader(spark, tmp_path):
    rows = [{"label": f"l{i}", "request": {"prompt": "".join(random.Random(i).choices(PARTS, k=9)), "project_id": None if i % 7 == 0 else "p", "author": "a"}} for i in range(120)]
    (tmp_path / "all.json").write_text(json.dumps(rows, indent=1))
    from auditlake import schemas

    whole = spark.read.schema(schemas.LABELLED_PROMPT).json(str(tmp_path), multiLine=True).select("label", "request.*")
    split = read_array(spark, str(tmp_path), schemas.LABELLED_PROMPT, 100).select("label", "request.*")
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, read_labelled(spark, str(tmp_path)).collect())) == sorted(map(str, whole.collect()))
    assert split.rdd.getNumPartitions() > 1


def test_written_arrays_are_arrays(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "concat('\"', id, '\\\\') AS text").repartition(3)
    write_arrays(df, str(tmp_path / "out"))
    found = [r for f in (tmp_path / "out").glob("part-*.json") for r in json.loads(f.read_text())]
    assert sorted(r["id"] for r in found) == list(range(50)) and all(r["text"] == f'"{r["id"]}\\' for r in found)


def test_quotes_behind_backslashes():
    for text in ['"', '\\"', '\\\\"', 'a"b\\\\\\"c"', "", "\\", '\\\\\\\\"']:
        for escaped in (False, True):
            raw, want, odd = text.encode(), [], escaped
            for i, b in enumerate(raw):
                if b == 0x22 and not odd:
                    want.append(i)
                odd = b == 0x5C and not odd
            assert quotes(np.frombuffer(raw, np.uint8), escaped).tolist() == want
