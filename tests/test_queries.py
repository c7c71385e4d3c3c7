"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import TABLES, canonical  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    ours, theirs = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(columns, result.fetchall())
    assert ours[0] == theirs[0]
    assert not ours[1] - theirs[1] and not theirs[1] - ours[1]


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
