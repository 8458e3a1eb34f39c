import pytest
from oracle_harness import compare

import __spark_entry__ as E
from cartlift.llm.queries import ORACLES, QUERIES

SF001 = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    ok, said = compare(QUERIES[name](spark, SF001), ORACLES[name], SF001)
    assert ok, said
