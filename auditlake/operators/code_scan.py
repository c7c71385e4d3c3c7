"""Line scan of source files: every line against every line rule, and what the findings add up to.

A file is given to the line split only if it holds a needle of some rule, and a line to a regex only if
it holds a needle of that rule. Hits of one line are a bit mask, so lines without any are dropped
before a row per finding is made. Everything is narrow; only the summaries shuffle, pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.rules import LINE_RULES, SEVERITIES, SNIPPET_CHARS, LineRule

FINDING_COLUMNS = [
    "severity", "category", "rule_id", "file", "line", "col", "snippet", "description", "remediation",
]


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): numbered from 1, the other columns of ``files`` dropped."""
    kept = files.filter(F.col("content") != "")
    return kept.select(
        "path", F.posexplode(text.lines_of(F.col("content"))).alias("pos", "line")
    ).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def has_needle(raw: Column, folded: Column, rule: LineRule) -> Column:
    return text.contains_any(folded if rule.ignore_case else raw, rule.needles)


def _may_hit(content: Column, folded: Column, rule_rows: Sequence[LineRule]) -> Column:
    return reduce(lambda a, b: a | b, [has_needle(content, folded, r) for r in rule_rows])


def _hit(line: Column, folded: Column, rule: LineRule) -> Column:
    pattern = text.regex(rule.pattern)
    if rule.ignore_case:
        pattern = "(?iu)" + pattern
    return has_needle(line, folded, rule) & line.rlike(pattern)


MASK_BITS = 63


def hit_mask(line: Column, folded: Column, rule_rows: Sequence[LineRule]) -> Column:
    """Bit i is set when rule i hits the line; for at most MASK_BITS rules."""
    bits = [
        F.when(_hit(line, folded, rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        for i, rule in enumerate(rule_rows)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _rule_table(rule_rows: Sequence[LineRule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_ord"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.description).alias("description"),
                F.lit(r.remediation).alias("remediation"),
            )
            for i, r in enumerate(rule_rows)
        ]
    )


def line_findings(files: DataFrame, rule_rows: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Files (path, content) to findings, at most one per line and rule; col is always 1."""
    if not rule_rows:
        raise ValueError("a line scan needs a rule")
    content, line, folded = F.col("content"), F.col("line"), F.col("folded")
    named = text.worked_out(files.select("path", "content"), text.fold(content), "folded")
    lines = text.worked_out(file_lines(named.filter(_may_hit(content, folded, rule_rows))), text.fold(line), "folded")
    parts = [rule_rows[i : i + MASK_BITS] for i in range(0, len(rule_rows), MASK_BITS)]
    masks = [f"mask{i}" for i in range(len(parts))]
    masked = lines.withColumns({name: hit_mask(line, folded, part) for name, part in zip(masks, parts)})
    hits = masked.filter(reduce(lambda a, b: a | b, [F.col(name) != 0 for name in masks]))
    each = hits.select("path", "line_no", "line", F.array(*masks).alias("masks"), F.inline(_rule_table(rule_rows))).filter(
        f"(shiftright(masks[rule_ord div {MASK_BITS}], rule_ord % {MASK_BITS}) & 1) = 1"
    )
    return each.select(
        "severity", "category", "rule_id", F.col("path").alias("file"), F.col("line_no").alias("line"),
        F.lit(1).alias("col"), F.substring(text.strip(F.col("line")), 1, SNIPPET_CHARS).alias("snippet"),
        "description", "remediation",
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def scan_totals(files: DataFrame, findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, lines and findings in total, or per value of the ``by`` columns that both inputs carry."""
    zero = F.lit(0).cast("long")
    measures = ["scanned_files", "total_lines", "total_findings", *SEVERITIES]
    sizes = files.select(
        *by, F.lit(1).cast("long").alias("scanned_files"),
        text.line_count(F.col("content")).cast("long").alias("total_lines"),
        *[zero.alias(m) for m in measures[2:]],
    )
    counts = findings.select(
        *by, zero.alias("scanned_files"), zero.alias("total_lines"), F.lit(1).cast("long").alias("total_findings"),
        *[(F.col("severity") == s).cast("long").alias(s) for s in SEVERITIES],
    )
    both = sizes.unionByName(counts)
    return both.groupBy(*by).agg(*[F.coalesce(F.sum(m), zero).alias(m) for m in measures])
