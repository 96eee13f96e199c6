"""Every registered query against its DuckDB check, at the smallest scale."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from arrearview.workload import CHECKS, QUERIES


def test_the_entry_point_has_every_query_and_check():
    assert QUERIES.items() <= entry.queries().items() and CHECKS.items() <= entry.oracle_sql().items()



@pytest.fixture(scope="module")
def con(star_dir):
    return connect(star_dir)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, star_dir, con):
    assert compare(QUERIES[name](spark, star_dir), con, CHECKS[name]) is None


def test_entry(spark):
    curve = entry.entry(spark)
    assert curve.columns == ["mob", "n", "n_full", "k", "rate"]
    rows = curve.collect()
    assert [r["mob"] for r in rows] == list(range(37)) and rows[-1]["k"] > 0
