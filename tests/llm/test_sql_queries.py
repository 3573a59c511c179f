"""The queries that SQL can express against DuckDB, and all of them for their columns."""

from __future__ import annotations

import pytest
from compare import DATA, duck, same

from thresher.llm.queries import QUERIES, SQL

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, db, name):
    assert same(QUERIES[name](spark, str(SF)), db, SQL[name]) == ""


def test_ten_operators_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
