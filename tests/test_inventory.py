from pyspark.sql import functions as F
from test_code import SOURCE

from auditlake.operators import inventory
from auditlake.operators.registry import Registry
from auditlake.sources import requirements


def facts(files_of, **files):
    return inventory.inventory_facts(files_of(**files))


def test_endpoints_and_models(files_of):
    found = facts(files_of, **{"a.py": SOURCE, "broken.py": "@app.get('/x')\ndef broken((:"})
    endpoints = [(r["path"], r["method"], r["handler"], r["module"], r["parameters"]) for r in inventory.endpoints_of(found).collect()]
    assert sorted(endpoints) == [
        ("", "DELETE", "remove", "a.py", []), ("/items", "POST", "create", "a.py", ["body", "user"]),
        ("/items/{id}", "GET", "read", "a.py", ["id"]), ("a.b", "PATCH", "inner", "a.py", []),
    ]
    assert sorted(r["name"] for r in inventory.models_of(found).collect()) == ["Item", "Row"]


def lines(spark, *texts):
    return spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project_id string, line_no int, line string")


def test_requirements(spark):
    parsed = requirements.parse(lines(spark, "fastapi==0.111.0", "# no", "", "  pydantic == 2.7.1 ", "foo>=1", "a==1 # c", "b==1==2", "fastapi==1"))
    assert [(r["name"], r["version"]) for r in parsed.orderBy("line_no").collect()] == [
        ("fastapi", "0.111.0"), ("pydantic", "2.7.1"), ("foo>=1", "unpinned"), ("a", "1 # c"), ("b", "1==2"), ("fastapi", "1")
    ]
    assert {r["name"]: r["version"] for r in requirements.latest(parsed).collect()}["fastapi"] == "1"


def build(spark, files_of, source, *pins) -> Registry:
    return inventory.build_registry(files_of(**{"p/a.py": source}), lines(spark, *pins), lambda m: F.substring_index(m, "/", 1))


def summary(registry):
    return inventory.context_summary(inventory.snapshot(registry)).first()


def test_checksum(spark, files_of):
    first = summary(build(spark, files_of, SOURCE, "a==1"))
    assert (first["n_endpoints"], first["n_models"], first["n_dependencies"], len(first["checksum"])) == (4, 2, 1, 12)
    assert summary(build(spark, files_of, SOURCE, "a==1"))["checksum"] == first["checksum"]
    assert summary(build(spark, files_of, SOURCE, "a==2"))["checksum"] != first["checksum"]
    longer = SOURCE + "\n@router.put('/y')\ndef y(): pass\n"
    assert summary(build(spark, files_of, longer, "a==1"))["checksum"] != first["checksum"]
    twice = SOURCE + '\n@router.delete(path="/z")\ndef remove(): pass\n'  # the same fact once more
    assert summary(build(spark, files_of, twice, "a==1"))["checksum"] != first["checksum"]


def test_nothing_found(spark, files_of):
    empty = build(spark, files_of, "x = 1\n")
    assert inventory.snapshot(empty).count() == 0


def test_snapshot_sink(spark, files_of, tmp_path):
    inventory.write_snapshot(inventory.snapshot(build(spark, files_of, SOURCE, "a==1")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 7


def test_inventory_feeds_the_audit(spark, files_of, prompts_of):
    from auditlake.operators.verdict import audit_prompts

    registry = build(spark, files_of, SOURCE, "stripe==9")
    row = audit_prompts(prompts_of(["delete /items of every item with stripe==10"], "p"), registry).first()
    assert [c["affected_component"] for c in row["conflicts"]] == ["route:/items", "model:Item", "dependency:stripe"]
