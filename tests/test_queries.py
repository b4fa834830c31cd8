"""Every query that SQL can express gives the SQL's rows; the others run."""

import pytest

from tests.oracle import differences
from tradewinds.plans import listings, oracle, queries, resolving, strategies, streams, upkeep, wording

ORACLE_SQL, QUERIES = oracle.ORACLE_SQL | upkeep.ORACLE_SQL | resolving.ORACLE_SQL | listings.ORACLE_SQL | strategies.ORACLE_SQL | streams.ORACLE_SQL | wording.ORACLE_SQL, queries.QUERIES | upkeep.QUERIES | resolving.QUERIES | listings.QUERIES | strategies.QUERIES | streams.QUERIES | wording.QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    assert differences(spark, SF, name, QUERIES[name], ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
