"""Every registered query against its SQL on the same files."""

import pytest

from talus.plans import load_all
from talus.plans.compare import compare, oracle_connection

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = oracle_connection(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, sf_dir, name):
    result = compare(spark, oracle, sf_dir, QUERIES[name], ORACLES[name])
    assert result["problem"] == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
