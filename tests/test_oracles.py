"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workloads.check import compare
from workloads.registry import ORACLES as SQL
from workloads.registry import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_pages", "n_lines", "char_count", "full"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    ok, message = compare(spark, sf, name, QUERIES[name], SQL[name])
    assert ok, message
