"""Every registered query that SQL can say, against that SQL; the others must run and keep a schema."""

import pytest

from gyrolith.plans import problems, series
from tests.oracle import check

SQL = {**problems.ORACLE, **series.ORACLE}
ALL = {**problems.QUERIES, **series.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    check(spark, sf_dir, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf_dir, name):
    rows = ALL[name](spark, sf_dir)
    assert rows.columns
    rows.collect()


def test_entry_point(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
