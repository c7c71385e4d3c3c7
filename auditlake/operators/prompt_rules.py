"""Text rules over prompts: a narrow projection, one nullable conflict per rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.rules import PROMPT_RULES, PromptRule
from auditlake.schemas import CONFLICT

Rule = PromptRule | Callable[[Column], Column]


def conflict(severity: str, category: str, description: Column, component: Column, remediation: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        description.alias("description"),
        component.alias("affected_component"),
        remediation.alias("remediation"),
    )


def first_hit(folded: Column, rule: PromptRule) -> Column:
    """The first pattern of the rule that hits the folded prompt, or null."""
    hit = F.coalesce(*[F.when(text.matches(folded, p), F.lit(p)) for p in rule.patterns])
    fires = text.contains_any(folded, rule.needles)
    if rule.unless is not None:
        fires = fires & ~text.matches(folded, rule.unless)
    return F.when(fires, hit)


def _found(rule: PromptRule, hit: Column) -> Column:
    if "{pattern}" in rule.description:
        head, tail = rule.description.split("{pattern}")
        description = F.concat(F.lit(head), hit, F.lit(tail))
    else:
        description = F.lit(rule.description)
    return conflict(rule.severity, rule.category, description, F.lit(rule.component), F.lit(rule.remediation))


def rule_conflict(prompts: DataFrame, rule: PromptRule, name: str = "conflict") -> DataFrame:
    """``prompts`` plus the rule's conflict, null where it does not fire."""
    folded = text.worked_out(prompts, text.fold(F.col("prompt")), "_folded")
    hits = text.worked_out(folded, first_hit(F.col("_folded"), rule), "_hit").drop("_folded")
    return hits.withColumn(name, F.when(F.col("_hit").isNotNull(), _found(rule, F.col("_hit")))).drop("_hit")


def security_conflicts(prompts: DataFrame, rules: Sequence[Rule] = PROMPT_RULES, name: str = "conflicts") -> DataFrame:
    """``prompts`` plus the array of all text rule conflicts, in rule order.

    The prompt is folded once and every pattern run once: hits are columns of their own. A rule may be a function from
    the prompt's column to a column made by ``conflict``, null where it does not fire.
    """
    none = F.array().cast(f"array<{CONFLICT.simpleString()}>")
    own = {i: rule(F.col("prompt")).cast(CONFLICT) for i, rule in enumerate(rules) if callable(rule)}
    hits = prompts.withColumn("_folded", text.fold(F.col("prompt"))).withColumns(
        {f"_hit{i}": own[i] if i in own else first_hit(F.col("_folded"), rule) for i, rule in enumerate(rules)}
    )
    one_each = [
        F.when(F.col(f"_hit{i}").isNotNull(), F.array(F.col(f"_hit{i}") if i in own else _found(rule, F.col(f"_hit{i}")))).otherwise(none)
        for i, rule in enumerate(rules)
    ]
    return hits.withColumn(name, F.concat(none, *one_each)).drop("_folded", *[f"_hit{i}" for i in range(len(rules))])
