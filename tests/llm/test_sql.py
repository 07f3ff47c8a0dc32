"""The corpus queries that SQL can express, over whole tables."""

import pytest
from compare import same
from conftest import DATA

from quillsift.llm import oracle, queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    same(queries.queries()[name](spark, f"{DATA}/sf0.001"), duck, SQL[name])
