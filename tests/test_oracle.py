"""Every registered query against its SQL, on the smallest data set."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    mine = spark_rows(QUERIES[name](spark, sf_dir))
    assert name in ORACLES
    assert difference(mine, duck_rows(duck, ORACLES[name])) is None


def test_comparison_sees_differences():
    columns = ["a", "b"]
    from checks.compare import rows_of

    one = rows_of(columns, [(1, "x"), (2, None)])
    assert difference(one, rows_of(["b", "a"], [(None, 2), ("x", 1)])) is None
    assert difference(one, rows_of(columns, [(1, "x"), (2, "y")])) is not None
    assert difference(one, rows_of(columns, [(1, "x")])) is not None
    assert difference(one, rows_of(["a", "c"], [(1, "x"), (2, None)])) is not None


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
