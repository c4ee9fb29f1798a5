"""Every registered query against its SQL check on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import compare  # noqa: E402

from searchloom.plans import ORACLES, QUERIES, load_all  # noqa: E402
from searchloom.plans.tables import TABLES  # noqa: E402

load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    message, _seconds, ok = compare(spark, con, name, sf_dir)
    assert ok, message


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
