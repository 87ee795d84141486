"""Every registered query against its SQL twin on the smallest tables; queries without one must return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.twin import compare, connect

SF = "/root/testdata/sf0.001"
TWINS = oracle_sql()
#: Queries whose answer is empty on the smallest tables: no text repeats there under other labels, or nothing is kept.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_runs(spark):
    assert entry(spark).count() == 1


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(queries())


@pytest.mark.parametrize("name", [n for n in queries() if n in TWINS])
def test_twin(spark, con, name):
    word = compare(queries()[name](spark, SF), con, TWINS[name])
    assert word == ("no rows" if name in EMPTY else None)


@pytest.mark.parametrize("name", [n for n in queries() if n not in TWINS])
def test_rows(spark, name):
    assert queries()[name](spark, SF).columns
    assert queries()[name](spark, SF).limit(1).count() == 1
