"""The driver contract: every query beside its SQL on the smallest data."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from workload.oracles import all_oracles
from workload.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(frame) > 0
    assert difference(frame, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["token_id", "token"] and df.count() > 0
