"""Every query of the subpackage with SQL gives the SQL's rows, every other one runs."""

import pytest

from conftest import DATA
from strandlake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same, name):
    if name in ORACLE:
        same(QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, str(DATA)).count() > 0
