"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from check import oracle_tables, rows_of

import __spark_entry__ as entry
from lexloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_tables(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    want = con.execute(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_entry_has_every_query():
    assert set(catalog.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
