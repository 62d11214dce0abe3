"""Every registered core query against its SQL twin on the smallest tables, and the others for running at all."""

import pytest

from passagelink.queries import load_all
from tests.harness import connect, spark_rows, sql_rows

REGISTRY = load_all()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql_twin(spark, data, duck, name):
    assert spark_rows(REGISTRY.queries[name](spark, data)) == sql_rows(duck, REGISTRY.sql[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_runs(spark, data, name):
    df = REGISTRY.queries[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_and_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "tfidf_topk" in e.queries()
