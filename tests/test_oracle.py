"""Every query with SQL gives the SQL's rows, every other one runs."""

import importlib

import pytest

from conftest import DATA

MODULES = {"sketch_queries": "sketch_sql", "classify_queries": "classify_sql", "io_queries": "io_queries", "skew_queries": "skew_queries"}


def load(name):
    return importlib.import_module(f"strandlake.plans.{name}")


CASES = [(n, q, load(s).ORACLE.get(n)) for m, s in MODULES.items() for n, q in load(m).QUERIES.items()]


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, same, name, query, sql):
    if sql is None:
        assert query(spark, str(DATA)).count() >= 0
    else:
        same(query, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "bucket_name", "score"]
