import os

import pytest
from oracle import DATA, same_rows

from stillroom.plans import catalogue, changes, matching

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
CASES = [(name, m.QUERIES[name], sql) for m in (catalogue, matching, changes) for name, sql in m.ORACLES.items()]


@pytest.mark.parametrize("name, query, sql", CASES, ids=[c[0] for c in CASES])
def test_query_against_sql(spark, name, query, sql):
    same_rows(spark, query, sql)


@pytest.mark.parametrize("name", sorted({n for m in (catalogue, matching, changes) for n in set(m.QUERIES) - set(m.ORACLES)}))
def test_other_queries_give_distinct_rows(spark, name):
    query = {**catalogue.QUERIES, **matching.QUERIES, **changes.QUERIES}[name]
    rows = [repr(r) for r in query(spark, DATA).collect()]
    assert len(rows) == len(set(rows))
