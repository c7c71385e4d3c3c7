"""Secrets in source and config files. A finding names the variable; the value is never projected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.rules import BARE_SUFFIXES, CONFIG_SUFFIXES, SECRET_RULES, SecretRule
from auditlake.operators.code_scan import file_lines
from auditlake.sources.files import ends_with_any


def _pattern(rule: SecretRule) -> str:
    return ("(?iu)" if rule.ignore_case else "") + text.regex(rule.pattern)


def _any_needle(folded: Column, rule_rows: Sequence[SecretRule]) -> Column:
    return text.contains_any(folded, sorted({n for r in rule_rows for n in r.needles}))


def secret_findings(
    files: DataFrame, rule_rows: Sequence[SecretRule] = SECRET_RULES, suffixes: Sequence[str] = CONFIG_SUFFIXES
) -> DataFrame:
    """Files (path, content) to (file, line, type, variable, description); one per line and kind."""
    folded = F.col("folded")
    chosen = files.filter(ends_with_any(F.col("path"), suffixes)).select("path", "content")
    named = text.worked_out(chosen, text.fold(F.col("content")), "folded").filter(_any_needle(folded, rule_rows))
    close = text.worked_out(file_lines(named), text.fold(F.col("line")), "folded").filter(_any_needle(folded, rule_rows))
    bare_file = ends_with_any(F.col("path"), BARE_SUFFIXES)

    def hit(rule: SecretRule) -> Column:
        fires = text.contains_any(folded, rule.needles) & F.col("line").rlike(_pattern(rule))
        return fires & bare_file if rule.bare else fires

    def name(rule: SecretRule) -> Column:
        return F.regexp_extract(F.col("line"), _pattern(rule), 1)

    kinds = list(dict.fromkeys(r.kind for r in rule_rows))
    found = F.array(
        *[
            F.struct(
                F.lit(kind).alias("type"),
                F.coalesce(*[F.when(hit(r), name(r)) for r in rule_rows if r.kind == kind]).alias("variable"),
            )
            for kind in kinds
        ]
    )
    each = close.select("path", "line_no", F.inline(found)).filter("variable is not null")
    variable = F.when(F.col("variable") == "", F.lit("an unnamed value")).otherwise(F.col("variable"))
    return each.select(
        F.col("path").alias("file"), F.col("line_no").alias("line"), "type", variable.alias("variable"),
        F.concat(F.lit("Hardcoded "), F.col("type"), F.lit(" found in "), variable).alias("description"),
    )
