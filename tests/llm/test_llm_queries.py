import pytest

from kilnwork.llm.queries import oracle_sql, queries

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_what_duckdb_gives(spark, name):
    assert_same(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
