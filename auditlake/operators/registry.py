"""A project's registry: endpoints, models and pinned dependencies, and checks of prompts against it.

Two shapes give the same conflicts. *Folded*: one nested row per project is broadcast and looked up
inside the prompt's row, with no shuffle; only used when the whole registry was measured to be small,
which also bounds every folded row. *Joined*: mentions are exploded and equi-joined, for any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rules, text
from auditlake.functions.sizing import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, Size, known_only, relation_bytes, salted_join, sized_join
from auditlake.operators import conflict_runs
from auditlake.operators.conflict_runs import let, run
from auditlake.operators.prompt_rules import conflict
from auditlake.schemas import CONFLICT
from auditlake.session import written

CONFLICTS = f"array<{CONFLICT.simpleString()}>"
MAX_FOLDED_FACTS_PER_PROJECT = 10_000


@dataclass(frozen=True)
class Registry:
    endpoints: DataFrame  # project_id, ord, path, method, ...
    models: DataFrame  # project_id, ord, name
    dependencies: DataFrame  # project_id, name, version

    def facts(self) -> DataFrame:
        """Every entry as a row of text, to be measured."""
        return (
            self.endpoints.select("project_id", F.concat_ws(" ", "path", "method").alias("fact"))
            .unionByName(self.models.select("project_id", F.col("name").alias("fact")))
            .unionByName(self.dependencies.select("project_id", F.concat_ws(" ", "name", "version").alias("fact")))
        )

    def can_fold(self) -> bool:
        """Whether the whole registry, and the largest project's share, were measured to be small."""
        sizes = self.facts().groupBy("project_id").agg(
            F.count("*").alias("rows"), F.sum(F.octet_length("fact")).alias("bytes")
        )
        most = sizes.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("rows").alias("largest")).first()
        whole = Size(most["rows"] or 0, most["bytes"] or 0)
        return (
            whole.rows <= MAX_BROADCAST_ROWS
            and relation_bytes(whole) <= MAX_BROADCAST_BYTES
            and (most["largest"] or 0) <= MAX_FOLDED_FACTS_PER_PROJECT
        )


def fill(template: str, **parts: Column) -> Column:
    """A text template as a concatenation of literals and columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(head), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def drift_conflict(path: Column, method: Column, verb: Column) -> Column:
    return conflict(
        rules.HIGH, "api_drift",
        fill(rules.DRIFT_DESCRIPTION, path=path, method=method, verb=verb),
        fill("route:{path}", path=path),
        fill(rules.DRIFT_REMEDIATION, path=path),
    )


def collision_conflict(name: Column) -> Column:
    return conflict(
        rules.MEDIUM, "schema_collision",
        fill(rules.COLLISION_DESCRIPTION, name=name), fill("model:{name}", name=name),
        F.lit(rules.COLLISION_REMEDIATION),
    )


def pin_conflict(name: Column, version: Column, pin: Column) -> Column:
    return conflict(
        rules.MEDIUM, "dependency",
        fill(rules.PIN_DESCRIPTION, name=name, version=version, pin=pin), fill("dependency:{name}", name=name),
        fill(rules.PIN_REMEDIATION, version=version, pin=pin),
    )


# ---- what a prompt mentions ------------------------------------------------------------------------


def paths_in(prompt: Column) -> Column:
    return text.find_all(prompt, rules.PATH_MENTION)


def verbs_in(prompt: Column) -> Column:
    """Upper-case verbs whose name occurs anywhere in the prompt, in the fixed order."""
    lowered = F.lower(prompt)
    return F.filter(
        F.array(*[F.when(lowered.contains(v), F.lit(v.upper())) for v in rules.VERBS]), lambda v: v.isNotNull()
    )


def versions_in(prompt: Column) -> Column:
    return F.arrays_zip(
        text.find_all(prompt, rules.VERSION_MENTION, 1).alias("name"),
        text.find_all(prompt, rules.VERSION_MENTION, 2).alias("version"),
    )


def tokens_in(prompt: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text.fold(prompt), F.lit(text.WORD_RUN), F.lit(0)))


def latest_endpoints(endpoints: DataFrame) -> DataFrame:
    """path -> method; of a repeated path the last endpoint counts. Combines before the shuffle.

    ``ord`` is a number or, from code, (module, place in it). Endpoints without a path are left out.
    """
    known = endpoints.filter(F.col("path").isNotNull())
    return known.groupBy("project_id", "path").agg(F.max_by("method", F.struct("ord", "method")).alias("method"))


def latest_pins(dependencies: DataFrame) -> DataFrame:
    """name -> version; of a repeated name the last ``ord`` counts if there is one, else the greatest version."""
    place = F.struct("ord", "version") if "ord" in dependencies.columns else F.col("version")
    known = dependencies.filter(F.col("name").isNotNull())
    return known.groupBy("project_id", "name").agg(F.max_by("version", place).alias("version"))


def keyed_models(models: DataFrame) -> DataFrame:
    """Adds ``key``, the first word run of the folded name, and ``pattern`` for names that are not one word.

    A whole-word mention of a name always contains its first word run as a whole word, so equality on
    ``key`` finds every candidate; only names with other characters need the regex on top.
    """
    models = models.filter(F.col("name").isNotNull())
    folded = text.fold(F.col("name"))
    key = F.regexp_extract(folded, f"({text.WORD_RUN})", 1)
    escaped = F.regexp_replace(folded, rf"([^\p{{L}}\p{{N}}_])", r"\\$1")
    edge = F.lit(text.regex(r"\b"))
    return models.select(
        "project_id", "ord", "name", key.alias("key"),
        F.when(key != folded, F.concat(F.lit("(?d)"), edge, escaped, edge)).alias("pattern"),
    )


# ---- folded shape ----------------------------------------------------------------------------------
# A folded table is an array of small maps: a lookup reads one of them, however large the project.

FOLD_BUCKETS = 16


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLD_BUCKETS)).cast("int")


def _fold(facts: DataFrame, key: str, value: Column) -> DataFrame:
    """(project_id, folded): key -> value; keys are unique per project."""
    entry = F.struct(F.col(key).alias("k"), value.alias("v"))
    buckets = facts.groupBy("project_id", _bucket(F.col(key)).alias("b")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("m")
    )
    by_bucket = buckets.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(FOLD_BUCKETS - 1))
    return by_bucket.select("project_id", F.transform(places, lambda i: F.try_element_at("m", i)).alias("folded"))


def _look_up(folded: Column, key: Column) -> Column:
    return F.try_element_at(F.get(folded, _bucket(key)), key)


def _with_folded(prompts: DataFrame, folded: DataFrame, needed: Column, found: Column, name: str) -> DataFrame:
    """Adds the conflicts that one folded table gives; prompts that cannot need it do not fetch their row."""
    keyed = prompts.withColumn("_key", F.when(needed, F.col("project_id")))
    joined = keyed.join(F.broadcast(folded.withColumnRenamed("project_id", "_key")), "_key", "left")
    hits = F.when(F.col("folded").isNotNull(), found.cast(CONFLICTS))
    return joined.withColumn(name, F.coalesce(hits, F.array().cast(CONFLICTS))).drop("_key", "folded")


def _folded_drift(prompts: DataFrame, registry: Registry, name: str) -> DataFrame:
    prompt, routes = F.col("prompt"), F.col("folded")
    known = F.filter(
        F.transform(paths_in(prompt), lambda p: F.struct(p.alias("path"), _look_up(routes, p).alias("method"))),
        lambda r: r["method"].isNotNull(),
    )

    def drifts(verbs: Column, route: Column) -> Column:
        other = F.filter(verbs, lambda v: v != route["method"])
        return F.transform(other, lambda v: drift_conflict(route["path"], route["method"], v))

    found = let(verbs_in(prompt), lambda verbs: F.flatten(F.transform(known, lambda r: drifts(verbs, r))))
    folded = _fold(latest_endpoints(registry.endpoints), "path", F.col("method"))
    return _with_folded(prompts, folded, prompt.contains("/"), found, name)


def _folded_collisions(prompts: DataFrame, registry: Registry, name: str) -> DataFrame:
    prompt, models = F.col("prompt"), F.col("folded")
    looked_up = F.transform(F.array_append(tokens_in(prompt), F.lit("")), lambda t: _look_up(models, t))
    named = F.flatten(F.filter(looked_up, lambda names: names.isNotNull()))
    text_ = text.fold(prompt)
    hit = F.filter(named, lambda m: m["pattern"].isNull() | F.rlike(text_, m["pattern"]))
    found = F.transform(F.array_sort(hit), lambda m: collision_conflict(m["name"]))
    names = keyed_models(registry.models).groupBy("project_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "pattern"))).alias("names")
    )
    return _with_folded(prompts, _fold(names, "key", F.col("names")), F.lit(True), found, name)


def _folded_pins(prompts: DataFrame, registry: Registry, name: str) -> DataFrame:
    prompt, pins = F.col("prompt"), F.col("folded")
    asked = F.transform(
        versions_in(prompt),
        lambda m: F.struct(m["name"].alias("name"), m["version"].alias("version"), _look_up(pins, m["name"]).alias("pin")),
    )
    differing = F.filter(asked, lambda m: (m["pin"] != "") & (m["pin"] != m["version"]))
    found = F.transform(differing, lambda m: pin_conflict(m["name"], m["version"], m["pin"]))
    folded = _fold(latest_pins(registry.dependencies), "name", F.col("version"))
    return _with_folded(prompts, folded, prompt.rlike("[=><~!]"), found, name)


def folded_conflicts(prompts: DataFrame, registry: Registry, name: str = "registry_conflicts") -> DataFrame:
    """``prompts`` plus drift, then collisions, then pin conflicts. Call only after ``can_fold``."""
    parts = {f"_{check.__name__}": check for check in (_folded_drift, _folded_collisions, _folded_pins)}
    for part, check in parts.items():
        prompts = check(prompts, registry, part)
    return prompts.withColumn(name, F.concat(*parts)).drop(*parts)


# ---- joined shape ----------------------------------------------------------------------------------
# Each check gives (key, project_id, check, seq, sub, conflict): one row per conflict, with its place. ``key`` names the
# column that tells prompts apart: the audit makes its own, as ids may be null or repeated.


_NAMED = ["path", "method", "verb", "name", "version", "pin"]  # what the conflicts' texts are made of


def _placed(df: DataFrame, key: str, check: int, seq: Column, sub: Column, found: Column, *extra: str) -> DataFrame:
    return df.select(key, "project_id", F.lit(check).alias("check"), seq.alias("seq"), sub.cast("long").alias("sub"), found.alias("conflict"), *extra)


def check_api_drift(prompts: DataFrame, endpoints: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Paths named in a prompt that are registered with another verb than the prompt implies."""
    mentions = prompts.filter(F.col("prompt").contains("/")).select(
        key, "project_id", verbs_in(F.col("prompt")).alias("verbs"),
        F.posexplode(paths_in(F.col("prompt"))).alias("seq", "path"),
    )
    known = sized_join(mentions, latest_endpoints(endpoints), ["project_id", "path"], F.col(key))
    each = known.select("*", F.posexplode("verbs").alias("sub", "verb")).filter("verb <> method")
    found = drift_conflict(F.col("path"), F.col("method"), F.col("verb"))
    return _placed(each, key, 1, F.col("seq").cast("long"), F.col("sub"), found, "path", "method", "verb")


def _collisions(prompts: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Prompts joined to the rows of ``keyed`` (project_id, key, pattern, name, ...) whose name they hold as a whole word, any case."""

    def candidates(tokens: Column, names: DataFrame) -> DataFrame:
        words = prompts.select(key, "project_id", F.explode(tokens).alias("key"))
        mentions = known_only(words, names, ["project_id", "key"])  # most words of a prompt name no model
        return sized_join(mentions, names, ["project_id", "key"], F.col(key))

    tokens = tokens_in(F.col("prompt"))
    hits = candidates(tokens, keyed.filter("pattern is null"))
    odd = keyed.filter("pattern is not null")
    if not odd.isEmpty():  # only these need the text again
        folded = prompts.select(key, text.fold(F.col("prompt")).alias("folded"))
        possible = candidates(F.array_append(tokens, F.lit("")), odd).join(folded.hint("merge"), key)
        hits = hits.unionByName(possible.filter("folded rlike pattern").drop("folded"))
    return hits


def check_schema_collision(prompts: DataFrame, models: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Registered models named as a whole word, any case; ``\\bName\\b`` became equality of word runs."""
    hits = _collisions(prompts, keyed_models(models).withColumnRenamed("ord", "seq"), key)
    return _placed(hits, key, 2, F.col("seq"), F.lit(0), collision_conflict(F.col("name")), "name")


def _collision_runs(prompts: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """The same with one row per prompt and name: n registrations from place ``seq`` to place ``last``. A missing place is the lowest."""
    registered = keyed_models(models).groupBy("project_id", "key", "pattern", "name").agg(
        F.when(F.count("ord") == F.count("*"), F.min("ord")).alias("seq"), F.max("ord").alias("last"), F.count("*").cast("int").alias("n")
    )
    hits = _collisions(prompts, registered, key)
    return _placed(hits, key, 2, F.col("seq"), F.lit(0), collision_conflict(F.col("name")), "name", "last", "n")


def check_dependency_conflict(prompts: DataFrame, dependencies: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Versions asked for that differ, as text, from a non-empty pin of the same name."""
    asked = prompts.filter(F.col("prompt").rlike("[=><~!]")).select(
        key, "project_id", F.posexplode(versions_in(F.col("prompt"))).alias("seq", "m")
    ).select(key, "project_id", "seq", "m.*")
    pins = latest_pins(dependencies).filter("version <> ''").select("project_id", "name", F.col("version").alias("pin"))
    differing = sized_join(asked, pins, ["project_id", "name"], F.col(key)).filter("pin <> version")
    found = pin_conflict(F.col("name"), F.col("version"), F.col("pin"))
    return _placed(differing, key, 3, F.col("seq").cast("long"), F.lit(0), found, "name", "version", "pin")


def _said(prompts: DataFrame, registry: Registry, key: str) -> DataFrame:
    """(key, said): what all three checks found, in order, models as (name, n, first and last place).

    Places within a check are numbers or, for models read from code, (module, place in it), so each check is ordered by
    its own kind of place.
    """
    checks = (
        check_api_drift(prompts, registry.endpoints, key),
        _collision_runs(prompts, registry.models, key),
        check_dependency_conflict(prompts, registry.dependencies, key),
    )
    places = [f"place{i}" for i in range(len(checks))]
    kinds = {p: found.schema["seq"].dataType for p, found in zip(places, checks, strict=True)} | dict.fromkeys(_NAMED, "string")
    kinds |= {"last": kinds["place1"], "n": "int"}
    parts = []
    for i, found in enumerate(checks):
        held = {c: found[c] for c in (*_NAMED, "last", "n") if c in found.columns} | {f"place{i}": found["seq"]}
        rest = [held.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()]
        parts.append(found.select(key, "check", "sub", "project_id", *rest))
    each = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = F.array_sort(F.collect_list(F.struct("check", *places, "sub", *_NAMED, "project_id", "last", "n")))
    return each.groupBy(key).agg(ordered.alias("said"))


def _mixed(said: Column) -> Column:
    """Whether a name's registrations lie between those of another one that the prompt names."""

    def crosses(c: Column, i: Column) -> Column:
        after = F.get(said, i + 1)
        beyond = F.struct(c["last"].alias("at"), c["name"].alias("name")) > F.struct(after["place1"].alias("at"), after["name"].alias("name"))
        return F.coalesce((c["check"] == 2) & (after["check"] == 2) & beyond, F.lit(False))

    return F.exists(F.transform(said, crosses), lambda x: x)


def _names_in_order(named: DataFrame, models: DataFrame) -> DataFrame:
    """(list, names): for each list of (project_id, name), by its hash, its registrations by place, as runs of names. Equal lists are asked once."""
    lists = named.select(F.sha2(F.to_json("named"), 256).alias("list"), "named").distinct()
    asked = lists.select("list", F.explode("named").alias("m")).select("list", "m.*")
    at = salted_join(models.filter("name is not null").select("project_id", "name", "ord"), asked, ["project_id", "name"], F.col("ord"))
    ordered = at.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("at"))
    return ordered.select("list", conflict_runs.runs_of(F.transform("at", lambda a: a["name"])).alias("names"))


def joined_runs(prompts: DataFrame, registry: Registry, key: str = "prompt_id") -> DataFrame:
    """(key, registry_runs): all three checks, in order, as runs of equal conflicts; a prompt's own mentions bound its array.

    A model may be registered many times: what is shuffled, ordered and stored is one entry per name that a prompt holds. Only if
    registrations of two of its names alternate, their places are fetched one by one, once for all prompts with these names.
    """
    stored = written(_said(prompts, registry, key))
    mixed = _mixed(F.col("said"))

    def made(of: Column) -> Column:
        def sentence(c: Column) -> Column:
            return (
                F.when(c["check"] == 1, drift_conflict(c["path"], c["method"], c["verb"]))
                .when(c["check"] == 2, collision_conflict(c["name"]))
                .otherwise(pin_conflict(c["name"], c["version"], c["pin"]))
            )

        return F.transform(of, lambda c: run(sentence(c), F.coalesce(c["n"], F.lit(1))))

    plain = stored.filter(~mixed).select(key, made(F.col("said")).cast(conflict_runs.KIND).alias("registry_runs"))
    alternating = stored.filter(mixed)
    if alternating.isEmpty():
        return plain

    def of_check(i: int) -> Column:
        return F.filter("said", lambda c: c["check"] == i)

    named = alternating.withColumn("named", F.transform(of_check(2), lambda c: F.struct(c["project_id"].alias("project_id"), c["name"].alias("name"))))
    asking = named.withColumn("list", F.sha2(F.to_json("named"), 256))
    met = asking.join(_names_in_order(named, registry.models).hint("merge"), "list")
    collisions = F.transform("names", lambda r: run(collision_conflict(r["value"]), r["n"]))
    runs = F.concat(*[part.cast(conflict_runs.KIND) for part in (made(of_check(1)), collisions, made(of_check(3)))])
    return plain.unionByName(met.select(key, runs.alias("registry_runs")))


def joined_conflicts(prompts: DataFrame, registry: Registry, key: str = "prompt_id") -> DataFrame:
    """(key, registry_conflicts): the conflicts of ``joined_runs`` one by one."""
    return joined_runs(prompts, registry, key).select(key, conflict_runs.each(F.col("registry_runs")).alias("registry_conflicts"))
