import json

import pytest
from conftest import PROJECT, make_registry
from pyspark.sql import functions as F

from auditlake.functions.rules import PROMPT_RULES, PromptRule
from auditlake.operators import registry as reg
from auditlake.operators.prompt_rules import conflict, rule_conflict
from auditlake.operators.verdict import audit_prompts, with_security
from auditlake.sources.prompts import accept, read_labelled, reject

# (rule, prompt, fires)
RULE_CASES = [
    (0, "Execute using cursor.execute to fetch data", True),
    (0, "Use the ORM to query users", False),
    (0, "run execute(query) now", True),
    (0, "run execute( query ) now", False),
    (0, "a RAW SQL report", True),
    (0, "drawraw sqlite", False),
    (0, "f\"select * from t", True),
    (0, "f'SELECT 1", True),
    (1, "Create an endpoint that skips auth for internal services", True),
    (1, "Add token authentication to the payment route", False),
    (1, "there is no authentication issue", True),
    (1, "bypass\nauth", False),
    (1, "a public page for the Admin", True),
    (2, "Set api_key=abc-123 in the headers", True),
    (2, "Read the API key from environment variables", False),
    (2, "apikey = ", False),
    (2, "SECRET =x", True),
    (3, "Add a webhook route for events", True),
    (3, "Add a webhook route and verify the HMAC signature", False),
    (3, "a webhook that verifies nothing", True),
    (4, "Add a new public API endpoint for user search", True),
    (4, "Add endpoint with rate limiting", False),
    (4, "Add endpoint with rate-limit", False),
    (4, "all routes, endpoints and apis", False),
    (4, "éapi", False),
    (4, "the api.", True),
]


def test_each_rule_hit_and_near_miss(spark, prompts_of):
    for i, rule in enumerate(PROMPT_RULES):
        cases = [(text, fires) for r, text, fires in RULE_CASES if r == i]
        rows = rule_conflict(prompts_of([c[0] for c in cases]), rule).orderBy("prompt_id").collect()
        assert [r["conflict"] is not None for r in rows] == [c[1] for c in cases], rule.rule_id
        for row in rows:
            if row["conflict"]:
                assert (row["conflict"]["severity"], row["conflict"]["category"]) == (rule.severity, "security")


def test_first_auth_pattern_is_named(prompts_of):
    row = rule_conflict(prompts_of(["bypass the admin auth, unauthenticated"]), PROMPT_RULES[1]).first()
    assert "'bypass.*auth'" in row["conflict"]["description"]


def test_own_rule_rows(prompts_of):
    own = PromptRule("X-1", "high", (r"\bfoo\b",), ("foo",), None, "part", "found foo", "remove foo")
    rows = with_security(prompts_of(["a foo", "food"]), [own]).orderBy("prompt_id").collect()
    assert [len(r["conflicts"]) for r in rows] == [1, 0]


# Labelled prompts with hand-traced results: conflicts in order, status, tests, cut.
GOLDEN = [
    ("Add a GET /reports/summary endpoint that returns aggregated sales data for the last 30 days with rate limiting at 60 requests per minute",
     [], "passed", 2, True),
    ("Add a new POST /payments/webhook route that processes Stripe subscription lifecycle events and updates the user's subscription status in the database",
     ["webhook handler", "API gateway", "model:User", "model:Subscription"], "needs_revision", 6, True),
    ("Add a POST /payments/webhook route that verifies the Stripe HMAC signature before processing subscription lifecycle events",
     ["API gateway", "model:Subscription"], "passed", 4, True),
    ("Write a search endpoint that uses cursor.execute to run a dynamic raw SQL query filtering orders by customer name",
     ["database layer", "API gateway"], "failed", 4, False),
    ("Create a public admin dashboard endpoint that bypasses auth and returns all user data for internal debugging",
     ["auth middleware", "API gateway", "model:User"], "failed", 5, False),
    ("Modify the User model to add a two_factor_enabled boolean field and a phone_number field for SMS-based 2FA",
     ["model:User"], "passed", 3, False),
    ("Upgrade stripe==10.0.0 to use the new Subscription V2 API with metered billing support",
     ["API gateway", "model:Subscription", "dependency:stripe"], "passed", 4, False),
    ("Add a DELETE endpoint at /users/me to allow account deletion", ["API gateway", "route:/users/me"], "needs_revision", 4, False),
    ("Use cursor.execute to run raw SQL and bypass auth for admin", ["database layer", "auth middleware"], "failed", 4, False),
    # order of registration, repeats, substrings, trailing characters
    ("POST on /payments/charge", [], "passed", 2, False),
    ("GET /orders", ["route:/orders"], "needs_revision", 3, False),
    ("delete /users/me and /users/me", ["route:/users/me"] * 2, "needs_revision", 3, False),
    ("compute the output of /users/me", ["route:/users/me"], "needs_revision", 3, False),
    ("delete /users/me/", [], "passed", 2, False),
    ("delete /users/me.", ["route:/users/me"], "needs_revision", 3, False),
    ("stripe>=9.4.0", [], "passed", 2, False),
    ("stripe==9.4.0.", ["dependency:stripe"], "passed", 2, False),
    ("stripe == 10", [], "passed", 2, False),
    ("requests~=2.31 unknown==1", ["dependency:requests"], "passed", 2, False),
    ("in order to", ["model:Order"], "passed", 3, False),
    ("orders", [], "passed", 2, False),
    ("PAYMENTINTENT then user, user", ["model:User", "model:PaymentIntent"], "passed", 4, False),
]


@pytest.mark.parametrize("fold", [True, False])
def test_golden_audits(prompts_of, registry, fold):
    rows = audit_prompts(prompts_of([g[0] for g in GOLDEN]), registry, fold=fold).orderBy("prompt_id").collect()
    for row, (prompt, components, status, n_tests, cut) in zip(rows, GOLDEN, strict=True):
        assert [c["affected_component"] for c in row["conflicts"]] == components, prompt
        assert (row["status"], len(row["recommended_tests"])) == (status, n_tests), prompt
        assert row["prompt_summary"].endswith(" [...]") == cut and len(row["prompt_summary"]) <= 120
        assert (row["author"], row["branch"], row["auto_remediation_applied"]) == ("anonymous", "main", False)


def test_messages_and_whole_rows_are_the_same_in_both_shapes(prompts_of, registry):
    prompts = prompts_of([g[0] for g in GOLDEN])
    folded, joined = (sorted(map(str, audit_prompts(prompts, registry, fold=f).collect())) for f in (True, False))
    assert folded == joined
    messages = [r["message"] for r in audit_prompts(prompts, registry).orderBy("prompt_id").collect()]
    assert messages[0] == "Audit passed — no conflicts detected. Safe to proceed."
    assert messages[1] == "Audit requires revision — 1 high-severity issue(s) found. Address before merging to production."
    assert messages[2] == "Audit passed with warnings. Review medium/low issues."
    assert messages[8] == "Audit FAILED — 2 critical issue(s) detected. Resolve all critical conflicts before proceeding."


@pytest.mark.parametrize("fold", [True, False])
def test_projects_without_registry_and_odd_model_names(spark, prompts_of, fold):
    registry = make_registry(spark, models=("User", "Order Item", "User", "$$", "Émoi"))
    own = prompts_of(["the order  item", "an Order Item of the USER", "order", "a $$ sign", "x$$y", "émoi", "émois"])
    rows = audit_prompts(own, registry, fold=fold).orderBy("prompt_id").collect()
    names = [[c["affected_component"][6:] for c in r["conflicts"]] for r in rows]
    assert names == [[], ["User", "Order Item", "User"], [], [], ["$$"], ["Émoi"], []]
    other = audit_prompts(prompts_of(["delete /users/me of the user"], "elsewhere"), registry, fold=fold).first()
    assert other["conflicts"] == [] and other["status"] == "passed"


def test_salted_join_is_used_beyond_the_limit(prompts_of, registry, monkeypatch):
    from auditlake.functions import sizing

    prompts = prompts_of([g[0] for g in GOLDEN])
    expected = sorted(map(str, audit_prompts(prompts, registry).collect()))
    monkeypatch.setattr(sizing, "fits", lambda *a, **k: False)
    monkeypatch.setattr(reg, "MAX_FOLDED_FACTS_PER_PROJECT", 3)
    assert not registry.can_fold()
    assert sorted(map(str, audit_prompts(prompts, registry).collect())) == expected


def test_both_shapes_agree_on_null_and_repeated_keys(spark, prompts_of):
    shop = make_registry(spark)
    more = shop.endpoints.unionByName(spark.createDataFrame([(PROJECT, 9, None, "GET"), (None, 9, "/a", "GET"), (PROJECT, 9, "/b", None)], shop.endpoints.schema))
    pins = shop.dependencies.unionByName(spark.createDataFrame([(PROJECT, "stripe", "1.0"), (PROJECT, None, "1"), (PROJECT, "odd", None)], shop.dependencies.schema))
    models = shop.models.unionByName(spark.createDataFrame([(PROJECT, 8, None), (PROJECT, 8, "User")], shop.models.schema))
    registry = reg.Registry(more, models, pins)
    prompts = prompts_of(["delete /users/me of the User, stripe==1.2 odd==1", "post /a and /b", "User"])
    prompts = prompts.unionByName(prompts).unionByName(prompts.withColumn("prompt_id", F.lit(None).cast("long")))
    folded, joined = (sorted(map(str, audit_prompts(prompts, registry, fold=f).collect())) for f in (True, False))
    assert folded == joined and len(folded) == 9
    found = audit_prompts(prompts, registry, fold=False).filter("prompt_id is null").collect()
    assert sorted(len(r["conflicts"]) for r in found) == [0, 2, 4]


def test_a_rule_may_be_a_function(prompts_of):
    def shouts(prompt):
        found = conflict("medium", "tone", F.lit("It shouts."), F.lit("prompt"), F.lit("Be calm."))
        return F.when(prompt == F.upper(prompt), found)

    rows = with_security(prompts_of(["RAW SQL", "raw sql", None]), [*PROMPT_RULES, shouts]).orderBy("prompt_id").collect()
    assert [[c["category"] for c in r["conflicts"]] for r in rows] == [["security", "tone"], ["security"], []]


def test_places_from_code_order_the_models(spark, prompts_of):
    place = "project_id string, ord struct<module:string,seq:long>"
    registry = reg.Registry(
        spark.createDataFrame([(PROJECT, ("b.py", 1), "/a", "GET"), (PROJECT, ("a.py", 2), "/a", "POST")], f"{place}, path string, method string"),
        spark.createDataFrame([(PROJECT, ("b.py", 1), "User"), (PROJECT, ("a.py", 2), "Order"), (PROJECT, ("a.py", 1), "Item")], f"{place}, name string"),
        spark.createDataFrame([], "project_id string, name string, version string"),
    )
    prompts = prompts_of(["user order item, post /a"])
    for fold in (True, False):
        (row,) = audit_prompts(prompts, registry, fold=fold).collect()
        assert [c["affected_component"] for c in row["conflicts"]] == ["route:/a", "model:Item", "model:Order", "model:User"]


def test_last_registration_counts(registry):
    assert {(r["path"], r["method"]) for r in reg.latest_endpoints(registry.endpoints).collect()} == {
        ("/payments/charge", "POST"), ("/users/me", "GET"), ("/orders", "POST")
    }


def test_intake(spark):
    rows = [(1, "p", "x", None, ""), (2, None, "x", "a", "b"), (3, "p", None, "a", "b"), (4, "", "x", "a", "b")]
    raw = spark.createDataFrame(rows, "prompt_id int, prompt string, project_id string, author string, branch string")
    assert [tuple(r)[3:] for r in accept(raw).orderBy("prompt_id").collect()] == [("anonymous", "main"), ("a", "b")]
    assert {(r["prompt_id"], r["missing_field"]) for r in reject(raw).collect()} == {(2, "prompt"), (3, "project_id")}


def test_bulk_load_of_an_array(spark, tmp_path):
    request = {"prompt": GOLDEN[0][0], "project_id": PROJECT}
    (tmp_path / "demo.json").write_text(json.dumps([{"label": "one", "request": request}, {"label": "two", "request": request | {"author": "me"}}]))
    rows = accept(read_labelled(spark, str(tmp_path / "demo.json"))).orderBy("label").collect()
    assert [(r["label"], r["author"], r["branch"]) for r in rows] == [("one", "anonymous", "main"), ("two", "me", "main")]


def test_ids_are_unique_per_prompt_and_repeatable(prompts_of, registry):
    prompts = prompts_of(["same text", "same text"])
    first, second = ([r["audit_id"] for r in audit_prompts(prompts, registry).orderBy("prompt_id").collect()] for _ in range(2))
    assert first == second and len(set(first)) == 2


def test_text_rules_stay_in_codegen(prompts_of):
    plan = with_security(prompts_of(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.lstrip().startswith("*")


def test_folded_audit_does_not_shuffle_prompts(prompts_of, registry):
    plan = audit_prompts(prompts_of(["x"]), registry, fold=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_a_model_registered_many_times_gives_a_conflict_each_in_order(spark, prompts_of):
    known = make_registry(spark, ["User"] * 3 + ["Order"] + ["User"])
    asked = prompts_of(["Extend User and Order, pin stripe==1.0, get /payments/charge", "nothing"])
    found = {r["prompt_id"]: [c["affected_component"] for c in r["registry_conflicts"]] for r in reg.joined_conflicts(asked, known).collect()}
    assert found == {0: ["route:/payments/charge", *["model:User"] * 3, "model:Order", "model:User", "dependency:stripe"]}


def test_conflicts_of_the_joined_shape_are_never_broadcast(prompts_of, registry):
    found = audit_prompts(prompts_of([g[0] for g in GOLDEN]), registry, fold=False)
    found.collect()  # the plan that ran
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_audit_row" in plan and "BroadcastHashJoin [_audit_row" not in plan


@pytest.mark.parametrize("places", [[0, 1, 2, 3, 4, 5, 6, 7], [3, 1, 2, 0, 7, 5, 6, 4], [None, 1, 1, None, 1, 0, 0, 2], [None] * 8])
def test_alternating_registrations_keep_their_order(spark, prompts_of, places):
    """Names that alternate, that don't, in two cases, of more than one word, without a place: as in the folded shape."""
    names = ["User", "Order", "User", "user", "User", "Item", "shop.item", "shop.item"]
    known = make_registry(spark, [])
    models = spark.createDataFrame([(PROJECT, p, n) for p, n in zip(places, names, strict=True)], "project_id string, ord long, name string")
    known = reg.Registry(known.endpoints, models, known.dependencies)
    asked = prompts_of(["user", "order and item", "Extend user, order and shop.item, pin stripe==1.0, get /payments/charge", "shop.item of a user", "nothing"] * 2)
    folded, joined = (sorted(map(str, audit_prompts(asked, known, fold=fold).collect())) for fold in (True, False))
    assert joined == folded and sum(len(r["registry_conflicts"]) for r in reg.joined_conflicts(asked, known).collect()) == 2 * (4 + 2 + 10 + 7)


def test_a_model_registered_many_times_is_one_entry_until_its_audit_is_stored(spark, prompts_of):
    """Of 1,000 registrations one entry is stored, shuffled and sorted; the audit still has 1,000 conflicts."""
    known, asked = make_registry(spark, ["User"] * 1000), prompts_of(["Extend User", "nothing"])
    (found,) = reg.joined_runs(asked, known).collect()
    assert [(r["value"]["affected_component"], r["n"]) for r in found["registry_runs"]] == [("model:User", 1000)]
    audits = audit_prompts(asked, known, fold=False)
    assert [len(r["conflicts"]) for r in audits.orderBy("prompt_id").collect()] == [1000, 0]
    assert {r["message"] for r in audits.collect()} == {r["message"] for r in audit_prompts(asked, known, fold=True).collect()}
    above, below = audits.select("*")._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)
    assert "array_repeat" in above and "array_repeat" not in below and "Exchange" in below
