"""The queries that SQL can express, against their SQL on the same files."""

import pytest

from talus.llm.queries import ORACLES, QUERIES
from talus.plans.compare import compare, oracle_connection

from tests.llm.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = oracle_connection(SMALL)
    assert compare(spark, con, SMALL, QUERIES[name], ORACLES[name])["problem"] == ""


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
