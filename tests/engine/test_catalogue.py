"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from foliomill.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ordered = lambda rows, cols: sorted(tuple(str(r[list(cols).index(c)]) for c in names) for r in rows)
    assert ordered([tuple(r) for r in got.collect()], got.columns) == ordered(want.fetchall(), want.columns)
