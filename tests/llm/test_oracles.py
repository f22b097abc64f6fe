"""Queries that SQL can express give DuckDB's rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import compare  # noqa: E402

from cairn.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(name, spark, sf_dir):
    compare.same(queries()[name](spark, sf_dir), compare.duck(sf_dir), oracle_sql()[name])
