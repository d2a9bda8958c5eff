import pytest

from kilnwork.plans.queries import QUERIES, SQL

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_duckdb_gives(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


def test_seeded_sample_repeats(spark):
    runs = [sorted(r.doc_id for r in QUERIES["seeded_sample"](spark, SF).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 20


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
