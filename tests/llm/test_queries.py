"""Queries with SQL equal DuckDB's result; the others are compared with brute force in their own files."""

import pytest

from oracle import assert_same, connect
from quillbase.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
