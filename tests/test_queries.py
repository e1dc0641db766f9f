import pytest
from oracle import SF, compare

import __spark_entry__
from dupweave.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, plans.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
