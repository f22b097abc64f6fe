"""Every query with SQL gives the rows that DuckDB does."""

import compare
import pytest

from cairn.plans import more_queries  # noqa: F401
from cairn.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, con):
    compare.same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_stream_equals_batch(spark, sf_dir):
    a, b = (compare.spark_rows(QUERIES[n](spark, sf_dir)) for n in ("recordings", "stream_recordings"))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
