from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_prompts import GOLDEN

from auditlake.operators import audit_log, id_index
from auditlake.operators.scan import scan
from auditlake.operators.verdict import audit_prompts
from auditlake.session import shared_dir, ship
from auditlake.sources import edited
from auditlake.streaming import code_stream, prompt_stream


@pytest.fixture(scope="module")
def audits(prompts_of, registry):
    prompts = prompts_of([g[0] for g in GOLDEN]).withColumn(
        "created_at", F.col("created_at") + F.expr("make_interval(0, 0, 0, 0, 6 * prompt_id)")
    )
    return audit_prompts(prompts, registry)


def text_rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip_and_lookup(spark, audits):
    path = shared_dir(spark)
    audit_log.append(audits, path)
    log = audit_log.read(spark, path)
    assert text_rows(log.select(audits.columns)) == text_rows(audits)
    wanted = audits.filter("prompt_id = 3").first()["audit_id"]
    one = audit_log.get_audit(log, wanted)
    assert one.first()["status"] == "failed" and audit_log.get_audit(log, "missing").count() == 0
    assert "PushedFilters: [IsNotNull(audit_id), EqualTo(audit_id" in one._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    ids = audits.filter("prompt_id < 4").select("audit_id")
    assert audit_log.get_audits(log, ids.union(ids)).count() == 4


def test_history(audits):
    newest = audit_log.history(audit_log.log_rows(audits), 3).collect()
    assert [r["conflicts"] for r in newest] == [len(GOLDEN[i][1]) for i in (21, 20, 19)]
    assert newest[0]["created_at"] == "2024-01-06T16:00:00.000000"
    assert audit_log.history(audit_log.log_rows(audits), 0).count() == 0
    with pytest.raises(ValueError):
        audit_log.history(audit_log.log_rows(audits), -1)


def test_rows_of_the_log_are_shuffled_with_their_conflicts_as_runs(spark, audits, monkeypatch):
    """Equal conflicts in a row take the space of one in what is shuffled, sorted and joined; the rows come out as they were."""
    monkeypatch.setattr(audit_log, "fits", lambda *a, **k: False)
    many = audits.withColumn("conflicts", F.flatten(F.transform("conflicts", lambda c: F.array_repeat(c, 3)))).localCheckpoint()
    path = shared_dir(spark)
    audit_log.append(many, path)
    log = audit_log.read(spark, path)
    assert text_rows(log.select(many.columns)) == text_rows(many)
    for found in (audit_log.first_per_id(many.unionByName(many)), audit_log.new_only(many, log.limit(0)), audit_log.get_audits(log, many)):
        assert text_rows(found.select(many.columns)) == text_rows(many)
        plan = found._jdf.queryExecution().executedPlan().toString()  # read from below: runs are made before the first shuffle of the conflicts
        assert "conflict_runs" in plan and "array_repeat" in plan.split("Exchange")[0]


@pytest.mark.parametrize("small", [True, False])
def test_only_new_ids_are_appended(spark, audits, monkeypatch, small):
    monkeypatch.setattr(audit_log, "fits", lambda *a, **k: small)
    path = shared_dir(spark)
    audit_log.append(audits.filter("prompt_id < 5"), path)
    later = audits.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    new = audit_log.new_only(later.unionByName(audits), audit_log.read(spark, path))
    assert text_rows(new.select(audits.columns)) == text_rows(audits.filter("prompt_id >= 5"))


def test_requests_without_ids_have_audits_of_their_own(prompts_of, registry):
    same = prompts_of(["Add an endpoint"] * 3).withColumns({"prompt_id": F.lit(None).cast("long"), "author": F.element_at(F.array(*map(F.lit, "aab")), F.col("prompt_id").cast("int") + 1)})
    ids = [r["audit_id"] for r in audit_prompts(same, registry).collect()]
    assert len(ids) == 3 and len(set(ids)) == 2  # two requests are equal in all they came with


def test_the_package_is_sent_to_executors_once(spark):
    ship(spark)
    ship(spark)
    assert [f for f in spark.sparkContext._python_includes].count("auditlake.zip") == 1


def test_json_columns(audits):
    assert text_rows(audit_log.from_json_columns(audit_log.to_json_columns(audits)).select(audits.columns)) == text_rows(audits)


def stream_of(spark, df):
    path = shared_dir(spark)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch_and_restarts_cleanly(spark, prompts_of, registry):
    prompts = prompts_of([g[0] for g in GOLDEN])
    expected = text_rows(audit_prompts(prompts, registry))
    source, log, checkpoint = stream_of(spark, prompts), shared_dir(spark), shared_dir(spark)
    for _ in range(2):  # the second run finds nothing new
        run(prompt_stream.audit_each_batch(source, registry, log, checkpoint))
    assert text_rows(prompt_stream.read_log(spark, log).select(audit_log.schemas.AUDIT.names)) == expected


def test_streams_take_large_registries(spark, prompts_of, registry, monkeypatch):
    prompts = prompts_of([g[0] for g in GOLDEN])
    expected = text_rows(audit_prompts(prompts, registry))
    monkeypatch.setattr(type(registry), "can_fold", lambda self: False)
    log, checkpoint = shared_dir(spark), shared_dir(spark)
    run(prompt_stream.audit_each_batch(stream_of(spark, prompts), registry, log, checkpoint))
    assert text_rows(prompt_stream.read_log(spark, log).select(audit_log.schemas.AUDIT.names)) == expected


def test_stream_logs_an_id_once(spark, audits):
    source, log, checkpoint = stream_of(spark, audits.unionByName(audits)), shared_dir(spark), shared_dir(spark)
    run(prompt_stream.append_to_log(source, log, checkpoint))
    assert text_rows(prompt_stream.read_log(spark, log).select(audits.columns)) == text_rows(audits)


def test_late_audits_are_not_lost_and_repeated_batches_replace_themselves(spark, audits):
    """Files newest first, a day apart, and the first once more: every id is logged once."""
    path = shared_dir(spark)
    for days in (3, 2, 1, 0, 3):
        shifted = audits.withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {days} DAY")).withColumn("audit_id", F.concat("audit_id", F.lit(days)))
        shifted.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(audits.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log, checkpoint = shared_dir(spark), shared_dir(spark)
    run(prompt_stream.append_to_log(source, log, checkpoint))
    ids = [r["audit_id"] for r in prompt_stream.read_log(spark, log).select("audit_id").collect()]
    assert len(ids) == len(set(ids)) == 4 * len(GOLDEN)
    # The first batch again, now with all there is.
    prompt_stream._store_new(spark.read.parquet(path), log, prompt_stream.writer_name(spark, checkpoint), 0)
    again = [r["audit_id"] for r in prompt_stream.read_log(spark, log).select("audit_id").collect()]
    assert sorted(again) == sorted(ids)


def test_two_writers_and_a_lost_checkpoint_lose_no_audit(spark, audits):
    log, parts = shared_dir(spark), [audits.filter(f"prompt_id % 3 = {i}") for i in range(3)]
    for part in parts:  # each with a checkpoint of its own, all begin with batch 0
        run(prompt_stream.append_to_log(stream_of(spark, part), log, shared_dir(spark)))
    assert text_rows(prompt_stream.read_log(spark, log).select(audits.columns)) == text_rows(audits)
    run(prompt_stream.append_to_log(stream_of(spark, audits), log, shared_dir(spark)))  # all again: nothing is new
    assert text_rows(prompt_stream.read_log(spark, log).select(audits.columns)) == text_rows(audits)


def test_ids_are_kept_in_a_state_store(spark, audits):
    log, checkpoint = shared_dir(spark), shared_dir(spark)
    run(prompt_stream.append_to_log(stream_of(spark, audits), log, checkpoint))
    state = spark.read.format("statestore").load(checkpoint)
    assert {r["id"] for r in state.selectExpr("key.audit_id AS id").collect()} == {r["audit_id"] for r in audits.select("audit_id").collect()}


def test_only_folders_that_may_hold_an_id_are_read(spark, audits):
    log, days = shared_dir(spark), {}
    for n in range(4):
        day = audits.filter(f"prompt_id % 4 = {n}").withColumn("created_at", F.expr(f"timestamp'2024-03-0{n + 1} 10:00:00'"))
        prompt_stream._store_new(day, log, "one", n)
        days |= {r["audit_id"]: n for r in day.select("audit_id").collect()}
    for wanted, n in list(days.items())[::5]:
        asked = spark.createDataFrame([(wanted,)], "audit_id string")
        folders = prompt_stream.folders_that_may_hold(spark, log, asked)
        assert f"{log}/writer=one/batch_id={n}/audit_date=2024-03-0{n + 1}" in folders and len(folders) <= 2
        found = prompt_stream.get_audits(spark, log, asked)
        assert [r["audit_id"] for r in found.collect()] == [wanted] and len(found.inputFiles()) <= 2
    nothing = spark.createDataFrame([("no such id",)], "audit_id string")
    assert prompt_stream.get_audits(spark, log, nothing).count() == 0
    assert prompt_stream.folders_that_may_hold(spark, shared_dir(spark), nothing) == []


def test_sketches_hold_all_ids_and_few_others():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = id_index.sketch(held)
    assert all(id_index.may_hold(bits, held[i : i + 1]) for i in range(0, 5000, 7)) and not id_index.may_hold(bits, held[:0])
    assert sum(id_index.may_hold(bits, others[i : i + 1]) for i in range(5000)) < 50
    assert id_index.may_hold(id_index.sketch(held[:1]), held[:1])


def test_history_reads_the_newest_days_only(spark, audits):
    path = shared_dir(spark)
    audit_log.append(audits, path)
    log = audit_log.read(spark, path)
    plan = audit_log.history(log, 3)._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert "PartitionFilters: [isnotnull(audit_date" in plan
    assert text_rows(audit_log.history(log, 3)) == text_rows(audit_log.history(audit_log.log_rows(audits).drop(audit_log.DAY), 3))
    assert audit_log.history(log, 10_000).count() == len(GOLDEN)


def test_a_missing_stamp_is_now(spark, audits):
    path = shared_dir(spark)
    audit_log.append(audits.withColumn("created_at", F.lit(None).cast("timestamp")), path)
    assert audit_log.read(spark, path).filter("created_at > current_timestamp() - INTERVAL 1 HOUR and audit_date is not null").count() == len(GOLDEN)


def test_code_stream_equals_batch(spark, files_of):
    files = files_of(**{f"{i}.py": "DEBUG = True\nmd5(x)\ntry:\n    x\nexcept:\n    pass\n" * i for i in range(1, 6)})
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    findings = code_stream.scan_stream(stream_of(spark, files))
    run(code_stream.write_findings(findings, path, checkpoint))
    assert text_rows(spark.read.schema(findings.schema).parquet(path)) == text_rows(scan(files))


def test_edited_files_come_again(spark, tmp_path):
    root, state, path, checkpoint = tmp_path / "tree", shared_dir(spark), shared_dir(spark), shared_dir(spark)
    (root / "venv").mkdir(parents=True)
    (root / "pkg").mkdir()

    def scan_now():
        run(code_stream.scan_edits(edited.watch_tree(spark, str(root), state), path, checkpoint))
        found = code_stream.current_findings(spark, path).collect()
        return sorted((r["file"], r["rule_id"], r["line"]) for r in found)

    assert code_stream.current_findings(spark, path).count() == 0
    (root / "a.py").write_text("DEBUG = True\n")
    (root / "pkg/__init__.py").write_text("x = 1\nmd5(x)\n")
    (root / "_b.py").write_text("DEBUG = True\n")
    (root / "venv/c.py").write_text("DEBUG = True\n")
    (root / "notes.txt").write_text("DEBUG = True\n")
    (root / "bad.py").write_bytes(b"\xff\xfe DEBUG = True")
    first = [("_b.py", "CFG-001", 1), ("a.py", "CFG-001", 1), ("pkg/__init__.py", "CRYPTO-001", 2)]
    assert scan_now() == first
    assert scan_now() == first  # nothing changed
    (root / "a.py").write_text("\n\nDEBUG = True\nos.system(x)\n")  # edited
    (root / "_b.py").unlink()  # deleted
    (root / "d.py").write_text("DEBUG=True")  # new
    assert scan_now() == [("a.py", "CFG-001", 3), ("a.py", "INJ-005", 4), ("d.py", "CFG-001", 1), ("pkg/__init__.py", "CRYPTO-001", 2)]
    (root / "a.py").write_text("\n")  # nothing is left to find
    (root / "_b.py").write_text("DEBUG = True\n")  # there again
    assert scan_now() == [("_b.py", "CFG-001", 1), ("d.py", "CFG-001", 1), ("pkg/__init__.py", "CRYPTO-001", 2)]


def test_edits_are_split_to_tasks_and_old_listings_go(tmp_path, monkeypatch):
    monkeypatch.setattr(edited, "TASK_FILES", 3)
    root, state = tmp_path / "tree", tmp_path / "state"
    root.mkdir()
    for i in range(10):
        (root / f"{i}.py").write_text("x")
    reader = edited.EditReader(str(root), str(state), ".py", "")
    assert reader.initialOffset() == {"listing": 0} and reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    parts = reader.partitions({"listing": 0}, {"listing": 1})
    assert [len(p.changed) for p in parts] == [3, 3, 3, 1]
    (root / "3.py").write_text("xy")
    (root / "4.py").unlink()
    assert reader.latestOffset() == {"listing": 2}
    parts = edited.EditReader(str(root), str(state), ".py", "").partitions({"listing": 1}, {"listing": 2})
    assert [(p.changed, p.gone) for p in parts] == [(["3.py"], []), ([], ["4.py"])]
    (root / "5.py").unlink()
    reader.latestOffset()
    reader.commit({"listing": 3})
    assert sorted(f.name for f in state.iterdir()) == ["2.json.gz", "3.json.gz"]


def test_ids_of_a_stream_are_kept_in_rocksdb_where_no_store_was_set(spark):
    spark.conf.unset(prompt_stream._STORE)
    prompt_stream._once(spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS audit_id"), "1 day")
    assert spark.conf.get(prompt_stream._STORE) == prompt_stream._ROCKS


def test_a_stream_stores_few_files_a_day(spark, prompts_of, registry, monkeypatch):
    """The stream's own session has no adaptive execution: each of its tasks would write a file for each day."""
    monkeypatch.setattr(type(registry), "can_fold", lambda self: False)
    prompts = prompts_of([f"Modify the User model for ticket {i}" for i in range(200)])
    prompts = prompts.withColumn("created_at", F.col("created_at") + F.expr("make_interval(0, 0, 0, prompt_id % 5)"))
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    source, log = stream_of(spark, prompts), shared_dir(spark)
    before = set(base.iterdir())
    run(prompt_stream.audit_each_batch(source, registry, log, shared_dir(spark)))
    stored = prompt_stream.read_log(spark, log)
    assert stored.count() == stored.select("audit_id").distinct().count() == 200
    batches = len({f.split("/batch_id=")[1].split("/")[0] for f in stored.inputFiles()})
    assert len(stored.inputFiles()) <= 5 * batches
    left = [f for f in set(base.iterdir()) - before if f.is_dir() and list(f.glob("*.parquet"))]
    assert not [f for f in left if "prompt" in spark.read.parquet(str(f)).columns]  # the batch's prompts are not left behind


def test_ids_are_asked_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    held, others = rng.integers(-(2**63), 2**63 - 1, 200), rng.integers(-(2**63), 2**63 - 1, 200)
    monkeypatch.setattr(id_index, "SLICE", 7)
    bits = id_index.sketch(held)
    others = np.array([h for h in others if not id_index.may_hold(bits, np.array([h]))])
    assert not id_index.may_hold(bits, others) and id_index.may_hold(bits, np.append(others, held[-1:]))
