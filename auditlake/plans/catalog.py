"""Every registered query: an operator on whole tables, flattened to scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.functions import rules, text
from auditlake.operators import (
    audit_log, code_scan, ignore_audit, ignore_rules, inventory, prompt_rules, registry as reg, retrieval, secret_scan, syntax, vector_index, verdict,
)
from auditlake.operators.scan import scan, scan_snippets, scan_source
from auditlake.plans import derive
from auditlake.session import shared_dir
from auditlake.sources import edited
from auditlake.sources import files as tree
from auditlake.sources import json_array
from auditlake.sources import prompts as prompt_source
from auditlake.sources import requirements
from auditlake.streaming import code_stream, prompt_stream

Query = Callable[[SparkSession, str], DataFrame]

_DETAILS = ["severity", "category", "description", "affected_component", "remediation"]


def _stamp() -> Column:
    return F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return prompt_source.accept(derive.intake(spark, d))


def _audits(spark: SparkSession, d: str) -> DataFrame:
    return verdict.audit_prompts(derive.intake(spark, d), derive.registry(spark, d))


def _flat(audits: DataFrame) -> DataFrame:
    return audits.select(
        "audit_id", "prompt_id", "project_id", "author", "branch", "status", "message", "prompt_summary",
        F.size("conflicts").cast("long").alias("n_conflicts"),
        F.size("recommended_tests").cast("long").alias("n_tests"), _stamp(),
    )


def _flat_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"line": F.col("line").cast("long"), "col": F.col("col").cast("long")})


# ---- sources and sinks -----------------------------------------------------------------------------


def prompt_intake(spark, d):
    return _prompts(spark, d).select("prompt_id", "prompt", "project_id", "author", "branch", _stamp())


def prompt_rejects(spark, d):
    return prompt_source.reject(derive.intake(spark, d)).select("prompt_id", "missing_field")


def prompt_bulk_load(spark, d):
    path = shared_dir(spark)
    prompt_source.write_labelled(derive.intake(spark, d).withColumn("label", F.upper("project_id")), path)
    loaded = prompt_source.accept(prompt_source.read_labelled(spark, path, json_lines=True))
    return loaded.select("label", "prompt", "project_id", "author", "branch")


def prompt_bulk_array(spark, d):
    """The same from array files, each cut to ranges of 64 KB."""
    path = shared_dir(spark)
    prompt_source.write_labelled(derive.intake(spark, d).withColumn("label", F.upper("project_id")), path, json_lines=False)
    loaded = json_array.read_array(spark, path, schemas.LABELLED_PROMPT, 64 << 10).select("label", "request.*")
    return prompt_source.accept(loaded).select("label", "prompt", "project_id", "author", "branch")


def source_tree_scan(spark, d):
    root = shared_dir(spark)
    tree.write_tree(derive.files(spark, d), root)
    return _flat_findings(scan_source(spark, path=root))


def snippet_scan(spark, d):
    """The documents as they are, nothing added."""
    return _flat_findings(scan_snippets(derive.document_snippets(spark, d)))


def snippet_scan_files(spark, d):
    """Source files as inline code: line rules and syntax-tree rules."""
    return _flat_findings(scan_snippets(derive.files(spark, d)))


def requirements_parse(spark, d):
    return requirements.parse(derive.requirement_lines(spark, d))


def audit_log_roundtrip(spark, d):
    path = shared_dir(spark)
    audit_log.append(_audits(spark, d), path)
    return _flat(audit_log.read(spark, path))


def audit_log_dedupe(spark, d):
    """Stored: the conversations' audits. Arriving: all audits, and all of them again an hour later."""
    path = shared_dir(spark)
    rules_registry = derive.registry(spark, d)
    audit_log.append(verdict.audit_prompts(derive.turns(spark, d), rules_registry), path)
    audits = _audits(spark, d)
    again = audits.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    return _flat(audit_log.new_only(audits.unionByName(again), audit_log.read(spark, path)))


def doc_upsert(spark, d):
    return retrieval.upsert_documents(derive.docs(spark, d)).select(
        "id", "ord", F.length("content").cast("long").alias("n_chars"), F.try_element_at("metadata", F.lit("lang")).alias("lang")
    )


def doc_append(spark, d):
    """The documents stored in two calls, their copies counted: appending replaces nothing."""
    path, docs = shared_dir(spark), derive.docs(spark, d)
    for half in (0, 1):
        retrieval.append_documents(docs.filter(F.col("ord") % 2 == half).drop("ord"), path)
    stored = retrieval.read_documents(spark, path)
    return stored.groupBy("id").agg(F.count("*").alias("n_docs"), F.count_distinct("ord").alias("n_places"), F.sum(F.length("content")).cast("long").alias("n_chars"))


# ---- prompt rules ----------------------------------------------------------------------------------


def _rule(rule: rules.PromptRule) -> Query:
    def query(spark, d):
        found = prompt_rules.rule_conflict(_prompts(spark, d), rule, "c")
        return found.filter("c is not null").select("prompt_id", "c.*")

    return query


# ---- registry --------------------------------------------------------------------------------------


def endpoint_latest(spark, d):
    return reg.latest_endpoints(derive.endpoints(spark, d))


def endpoint_latest_code(spark, d):
    """The same over endpoints read from code, whose order is (module, place in it)."""
    return reg.latest_endpoints(_code_registry(spark, d).endpoints)


def _placed(found: DataFrame) -> DataFrame:
    return found.select("prompt_id", "seq", "sub", "conflict.*")


def api_drift(spark, d):
    return _placed(reg.check_api_drift(_prompts(spark, d), derive.endpoints(spark, d)))


def schema_collision(spark, d):
    return _placed(reg.check_schema_collision(_prompts(spark, d), derive.models(spark, d)))


def dependency_conflict(spark, d):
    return _placed(reg.check_dependency_conflict(_prompts(spark, d), derive.registry(spark, d).dependencies))


# ---- verdict ---------------------------------------------------------------------------------------


def _each(audits: DataFrame, column: str) -> DataFrame:
    """One row per element. The outer form keeps the optimizer from working the array out again in a filter."""
    return audits.select("prompt_id", F.posexplode_outer(column).alias("pos", "c")).filter("pos is not null")


def audit_conflicts(spark, d):
    each = _each(_audits(spark, d), "conflicts")
    return each.select("prompt_id", F.col("pos").cast("long").alias("pos"), "c.*")


def severity_counts(spark, d):
    def n(severity: str):
        return verdict.count_severity(F.col("conflicts"), severity).cast("long").alias(severity)

    return _audits(spark, d).select("prompt_id", *[n(s) for s in (rules.CRITICAL, rules.HIGH, rules.MEDIUM)])


def audit_verdict(spark, d):
    return _flat(_audits(spark, d))


def audit_verdict_joined(spark, d):
    """The whole audit in the shape for registries of any size."""
    return _flat(verdict.audit_prompts(derive.intake(spark, d), derive.registry(spark, d), fold=False))


def custom_rule(spark, d):
    """A rule given as a function of the prompt's column, with a category of its own."""

    def names_a_password(prompt: Column) -> Column:
        found = prompt_rules.conflict(rules.MEDIUM, "policy", F.lit("Prompt names a password."), F.lit("prompt"), F.lit("Leave it out."))
        return F.when(F.lower(prompt).contains("password"), found)

    found = verdict.with_security(_prompts(spark, d), [names_a_password])
    return found.select("prompt_id", F.explode_outer("conflicts").alias("c")).filter("c is not null").select("prompt_id", "c.*")


def test_suggestions(spark, d):
    each = _each(_audits(spark, d), "recommended_tests")
    return each.select("prompt_id", F.col("pos").cast("long").alias("pos"), F.col("c").alias("test"))


def prompt_summary(spark, d):
    return _prompts(spark, d).select("prompt_id", text.shorten(F.col("prompt")).alias("prompt_summary"))


# ---- code and secrets ------------------------------------------------------------------------------


def file_lines(spark, d):
    lines = code_scan.file_lines(derive.files(spark, d))
    return lines.select("path", F.col("line_no").cast("long").alias("line_no"), "line")


def code_findings(spark, d):
    return _flat_findings(code_scan.line_findings(derive.files(spark, d)))


def scan_summary(spark, d):
    return code_scan.severity_summary(scan(derive.files(spark, d)))


def scan_rollup(spark, d):
    def project(path: str):
        return F.substring_index(path, "/", 1).alias("project_id")

    source = derive.files(spark, d)
    findings = scan(source)
    return code_scan.scan_totals(
        source.select(project("path"), "content"), findings.select(project("file"), "severity"), ["project_id"]
    )


def ast_findings(spark, d):
    return _flat_findings(syntax.ast_findings(derive.files(spark, d)))


def parse_errors(spark, d):
    return syntax.parse_errors(derive.files(spark, d))


def _flat_secrets(found: DataFrame) -> DataFrame:
    return found.withColumn("line", F.col("line").cast("long"))


def secret_findings(spark, d):
    return _flat_secrets(secret_scan.secret_findings(derive.config_files(spark, d)))


def page_secret_findings(spark, d):
    return _flat_secrets(secret_scan.secret_findings(derive.pages(spark, d)))


def ignore_audit_report(spark, d):
    report = ignore_audit.audit_ignores(derive.roots(spark, d), derive.ignore_lines(spark, d))
    return report.withColumns(
        {c: F.array_join(c, " ") for c in ("present_patterns", "missing_patterns")}
    )


def env_exposed(spark, d):
    return ignore_audit.exposed_env(derive.config_files(spark, d), derive.ignore_lines(spark, d))


def ignore_globs(spark, d):
    return ignore_rules.with_ignored(derive.glob_files(spark, d), derive.glob_lines(spark, d))


def secret_rollup(spark, d):
    found = secret_scan.secret_findings(derive.config_files(spark, d))
    by_root = found.withColumn("root", F.substring_index("file", "/", 1))
    reports = ignore_audit.audit_ignores(derive.roots(spark, d), derive.ignore_lines(spark, d))
    return ignore_audit.rollup(by_root, reports).select(
        "root", "n_findings", F.array_join("types", " ").alias("types"), "gitignore_found", "is_sufficient"
    )


# ---- inventory -------------------------------------------------------------------------------------


def extract_endpoints(spark, d):
    found = inventory.endpoints_of(inventory.inventory_facts(derive.files(spark, d)))
    return found.select("path", "method", "handler", "module", F.array_join("parameters", ",").alias("parameters"), "return_type")


def extract_models(spark, d):
    return inventory.models_of(inventory.inventory_facts(derive.files(spark, d))).select("name", "module")


def dependency_latest(spark, d):
    return requirements.latest(requirements.parse(derive.requirement_lines(spark, d)))


def _code_registry(spark, d) -> reg.Registry:
    return inventory.build_registry(
        derive.files(spark, d), derive.requirement_lines(spark, d), lambda module: F.substring_index(module, "/", 1)
    )


def context_snapshot(spark, d):
    return inventory.snapshot(_code_registry(spark, d))


def context_checksum(spark, d):
    return inventory.context_summary(inventory.snapshot(_code_registry(spark, d)))


# ---- retrieval -------------------------------------------------------------------------------------


def _flat_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.col("rank").cast("long"))


def keyword_topk(spark, d):
    return _flat_hits(retrieval.keyword_topk(derive.docs(spark, d), derive.queries(spark, d), 5))


def keyword_topk_large(spark, d):
    """The same as if neither side were small."""
    return _flat_hits(retrieval.keyword_topk(derive.docs(spark, d), derive.queries(spark, d), 5, max_rows=0))


def keyword_documents(spark, d):
    docs = derive.docs(spark, d)
    hits = retrieval.with_documents(retrieval.keyword_topk(docs, derive.queries(spark, d), 1), docs)
    return hits.select("query_id", "id", F.try_element_at("metadata", F.lit("source")).alias("source"), F.md5("content").alias("content_md5"))


def doc_count(spark, d):
    return retrieval.doc_count(derive.docs(spark, d))


def knn_cosine(spark, d):
    return _flat_hits(retrieval.knn_cosine(derive.vectors(spark, d), derive.label_vectors(spark, d), 5))


def _indexed(spark, d, exact: bool) -> DataFrame:
    """Every row whose id is divisible by 20 asks all rows."""
    vectors = derive.vectors(spark, d)
    asked = vectors.filter(F.col("ord") % 20 == 0).withColumnRenamed("ord", "query_id")
    return _flat_hits(vector_index.knn_indexed(vector_index.build_index(vectors), asked, 6, exact=exact))


def knn_ann(spark, d):
    """By the cells that hold the asked share of neighbours; no SQL, as a few are missed."""
    return _indexed(spark, d, exact=False)


def knn_indexed(spark, d):
    return _indexed(spark, d, exact=True)


def prompt_context_topk(spark, d):
    """Every prompt is a query, the benchmark items are the context documents."""
    context = derive.queries(spark, d).withColumnsRenamed({"query_id": "ord", "text": "content"})
    asked = _prompts(spark, d).select(F.col("prompt_id").alias("query_id"), F.col("prompt").alias("text"))
    return _flat_hits(retrieval.keyword_topk(context, asked, 3))


# ---- log queries -----------------------------------------------------------------------------------


def audit_lookup(spark, d):
    """Every purchase asks the stored log for the audit of its own prompt."""
    path = shared_dir(spark)
    audit_log.append(_audits(spark, d), path)
    log = audit_log.read(spark, path)
    wanted = prompt_source.accept(derive.purchases(spark, d)).select(verdict.audit_id_of().alias("audit_id"))
    return _flat(audit_log.from_json_columns(audit_log.to_json_columns(audit_log.get_audits(log, wanted))))


def audit_history(spark, d):
    path = shared_dir(spark)
    audit_log.append(_audits(spark, d), path)
    newest = audit_log.history(audit_log.read(spark, path), audit_log.STORE_LIMIT)
    return newest.withColumn("conflicts", F.col("conflicts").cast("long"))


# ---- streams ---------------------------------------------------------------------------------------


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_audit(spark, d):
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    prompts, known = derive.event_stream(spark, d), derive.registry(spark, d)
    _run(prompt_stream.audit_each_batch(prompts, known, path, checkpoint))
    return _flat(prompt_stream.read_log(spark, path))


def stream_dedupe(spark, d):
    """Every prompt arrives twice; its audit is logged once."""
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    once = derive.event_stream(spark, d)
    prompts = prompt_source.accept(once.unionByName(derive.event_stream(spark, d)))
    audits = verdict.verdict(verdict.with_security(verdict.describe(prompts)))
    _run(prompt_stream.append_to_log(audits, path, checkpoint))
    return _flat(prompt_stream.read_log(spark, path))


def stream_late_audits(spark, d):
    """Event prompts arrive newest first, a quarter at a time, the newest quarter again at the end; each is logged once."""
    source, path, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    prompts = derive.event_prompts(spark, d)
    cuts = prompts.selectExpr("percentile_approx(unix_micros(created_at), array(0.25, 0.5, 0.75)) AS cuts").first()["cuts"] or []
    quarter = sum((F.coalesce(F.unix_micros("created_at") > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for i in (3, 2, 1, 0, 3):
        prompts.filter(quarter == i).repartition(2).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", 2).parquet(source)
    audits = verdict.verdict(verdict.with_security(verdict.describe(prompt_source.accept(arriving))))
    _run(prompt_stream.append_to_log(audits, path, checkpoint))
    return _flat(prompt_stream.read_log(spark, path))


def stream_lookup(spark, d):
    """Every purchase asks the streams' log for the audit of its own prompt; two writers, each with half of the events."""
    path = shared_dir(spark)
    prompts, known = derive.event_stream(spark, d), derive.registry(spark, d)
    for half in (0, 1):
        _run(prompt_stream.audit_each_batch(prompts.filter(F.col("prompt_id") % 2 == half), known, path, shared_dir(spark)))
    wanted = prompt_source.accept(derive.purchases(spark, d)).select(verdict.audit_id_of().alias("audit_id"))
    return _flat(prompt_stream.get_audits(spark, path, wanted))


def stream_code_scan(spark, d):
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    findings = code_stream.scan_stream(derive.file_stream(spark, d))
    _run(code_stream.write_findings(findings, path, checkpoint))
    return _flat_findings(spark.read.schema(findings.schema).parquet(path))


def stream_edits(spark, d):
    """A tree is scanned as it is written; then a third of the files are edited and a third deleted."""
    root, state, path, checkpoint = (shared_dir(spark) for _ in range(4))
    source = derive.files(spark, d)
    tree.write_tree(source, root)
    kind = F.length("path") % 3
    for step in range(2):
        _run(code_stream.scan_edits(edited.watch_tree(spark, root, state), path, checkpoint))
        if step == 0:
            tree.write_tree(source.filter(kind == 0).withColumn("content", F.concat("content", F.lit("\nDEBUG = True\n"))), root)
            tree.delete_files(source.filter(kind == 1), root)
    return _flat_findings(code_stream.current_findings(spark, path))


QUERIES: dict[str, Query] = {
    "prompt_intake": prompt_intake,
    "prompt_rejects": prompt_rejects,
    "prompt_bulk_load": prompt_bulk_load,
    "prompt_bulk_array": prompt_bulk_array,
    "source_tree_scan": source_tree_scan,
    "snippet_scan": snippet_scan,
    "snippet_scan_files": snippet_scan_files,
    "requirements_parse": requirements_parse,
    "audit_log_roundtrip": audit_log_roundtrip,
    "audit_log_dedupe": audit_log_dedupe,
    "doc_upsert": doc_upsert,
    "doc_append": doc_append,
    "rule_raw_sql": _rule(rules.PROMPT_RULES[0]),
    "rule_auth_bypass": _rule(rules.PROMPT_RULES[1]),
    "rule_prompt_secret": _rule(rules.PROMPT_RULES[2]),
    "rule_webhook_unsigned": _rule(rules.PROMPT_RULES[3]),
    "rule_rate_limit": _rule(rules.PROMPT_RULES[4]),
    "api_drift": api_drift,
    "endpoint_latest": endpoint_latest,
    "endpoint_latest_code": endpoint_latest_code,
    "schema_collision": schema_collision,
    "dependency_conflict": dependency_conflict,
    "audit_conflicts": audit_conflicts,
    "severity_counts": severity_counts,
    "audit_verdict": audit_verdict,
    "audit_verdict_joined": audit_verdict_joined,
    "custom_rule": custom_rule,
    "test_suggestions": test_suggestions,
    "prompt_summary": prompt_summary,
    "file_lines": file_lines,
    "code_findings": code_findings,
    "scan_summary": scan_summary,
    "scan_rollup": scan_rollup,
    "ast_findings": ast_findings,
    "parse_errors": parse_errors,
    "secret_findings": secret_findings,
    "page_secret_findings": page_secret_findings,
    "secret_rollup": secret_rollup,
    "ignore_audit": ignore_audit_report,
    "env_exposed": env_exposed,
    "ignore_globs": ignore_globs,
    "extract_endpoints": extract_endpoints,
    "extract_models": extract_models,
    "dependency_latest": dependency_latest,
    "context_snapshot": context_snapshot,
    "context_checksum": context_checksum,
    "keyword_topk": keyword_topk,
    "keyword_topk_large": keyword_topk_large,
    "keyword_documents": keyword_documents,
    "doc_count": doc_count,
    "knn_cosine": knn_cosine,
    "knn_ann": knn_ann,
    "knn_indexed": knn_indexed,
    "prompt_context_topk": prompt_context_topk,
    "audit_lookup": audit_lookup,
    "audit_history": audit_history,
    "stream_audit": stream_audit,
    "stream_dedupe": stream_dedupe,
    "stream_late_audits": stream_late_audits,
    "stream_lookup": stream_lookup,
    "stream_code_scan": stream_code_scan,
    "stream_edits": stream_edits,
}
