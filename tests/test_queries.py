"""Each registered query against its SQL."""

from __future__ import annotations

import pytest

from quillspark.plans import registry
from tests.oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Queries that find nothing, and why.
EMPTY = {"series_with_all_genres_repeated": "a name that is asked for twice is never held twice", "ambiguous_ids": "ids repeat from the 1900th part on, so only the smallest tables have none"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    got = spark_rows(registry.QUERIES[name](spark, sf_dir))
    assert got == sql_rows(con, registry.ORACLE[name])
    assert got[1] or name in EMPTY


def test_every_query_has_sql():
    assert sorted(registry.QUERIES) == sorted(registry.ORACLE)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
