import pytest
from helpers import database, same

from quarry.plans import oracle
from quarry.plans.queries import queries

ALL = queries()


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, data, db, name):
    same(ALL[name](spark, data), db.sql(oracle.SQL[name]))


def test_every_query_has_sql_but_the_embedding():
    assert set(ALL) - set(oracle.SQL) == {"hash_embedding"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
