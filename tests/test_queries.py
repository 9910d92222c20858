"""Every query of the catalogue against its SQL; those without SQL run and keep their shape."""

import pytest

from terrafold.queries import QUERIES, SQL
from tests.support import SF, duck, same_rows


@pytest.fixture(scope="module")
def con():
    return duck()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_without_the_optional_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
