"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest
from compare import same
from conftest import DATA

from quillsift.plans import oracle, queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    same(queries.queries()[name](spark, f"{DATA}/sf0.001"), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark).collect()
    assert {"qid", "rank", "docid", "score", "rank_shift", "snippet"} == set(found[0].asDict()) and len(found) > 10
    assert set(e.oracle_sql()) <= set(e.queries())
