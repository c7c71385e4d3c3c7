import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from auditlake.operators.registry import Registry  # noqa: E402
from auditlake.session import build_session  # noqa: E402

PROJECT = "shop"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("shared"))
    session = build_session("local[4]", 4, spark__checkpoint__dir=base)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_registry(spark, models=("User", "Order", "PaymentIntent", "Subscription")) -> Registry:
    # The registry the golden results were traced with.
    endpoints = [("/payments/charge", "POST"), ("/users/me", "GET"), ("/orders", "GET"), ("/orders", "POST")]
    pins = [("fastapi", "0.111.0"), ("sqlalchemy", "2.0.30"), ("stripe", "9.4.0"), ("pydantic", "2.7.1")]
    return Registry(
        spark.createDataFrame(
            [(PROJECT, i, p, m) for i, (p, m) in enumerate(endpoints)],
            "project_id string, ord long, path string, method string",
        ),
        spark.createDataFrame([(PROJECT, i, n) for i, n in enumerate(models)], "project_id string, ord long, name string"),
        spark.createDataFrame(
            [(PROJECT, n, v) for n, v in [*pins, ("requests", "unpinned")]],
            "project_id string, name string, version string",
        ),
    )


@pytest.fixture(scope="session")
def registry(spark):
    return make_registry(spark)


@pytest.fixture(scope="session")
def prompts_of(spark):
    def make(texts, project=PROJECT):
        rows = [(i, t, project, None, "") for i, t in enumerate(texts)]
        schema = "prompt_id long, prompt string, project_id string, author string, branch string"
        return spark.createDataFrame(rows, schema).selectExpr("*", "timestamp'2024-01-01 10:00:00' AS created_at")

    return make


@pytest.fixture(scope="session")
def files_of(spark):
    def make(**or_pairs):
        return spark.createDataFrame(list(or_pairs.items()), "path string, content string")

    return make
