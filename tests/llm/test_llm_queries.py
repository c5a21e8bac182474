import os

import pytest
from oracle import DATA, same_rows

from stillroom.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_distinct_rows(spark, name):
    rows = [repr(r) for r in QUERIES[name](spark, DATA).collect()]
    assert rows and len(rows) == len(set(rows))
