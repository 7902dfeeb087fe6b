"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import glob
import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandlake.runtime import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, spark__checkpoint__dir=f"file://{folder}", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not DATA.is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{files}'")
    return con


def normal(rows, names):
    """Rows with columns by name, in an order of their own, floats to nine digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return x

    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture
def same(spark, duck):
    def check(query, sql):
        df = query(spark, str(DATA))
        ours = normal([tuple(r) for r in df.collect()], df.columns)
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert ours == normal(result.fetchall(), names)

    return check
