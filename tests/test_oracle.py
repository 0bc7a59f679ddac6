"""Every query with SQL gives the rows that DuckDB gives over the smallest tables."""

import pytest

import oracle
from tidemark import catalog, catalog_choice, catalog_edits, catalog_more, catalog_previews, catalog_profiles, catalog_review, catalog_series, catalog_setup, catalog_shapes  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert oracle.differences(con, catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
