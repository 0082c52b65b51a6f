import math
import os

import duckdb
import pytest

from lumenary.plans import catalogue
from lumenary.session import TABLES

DATA = os.environ.get("FIXTURES", "/root/testdata/sf0.001")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.6f}".replace("-0.000000", "0.000000")
        return "none" if x is None else x.isoformat() if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the fixture tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
