"""The operators that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gristmill import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    r = duck.execute(llm.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(str(plain(v)) for _, v in sorted(zip(columns, row, strict=True))) for row in r.fetchall())
    got = sorted(tuple(str(plain(row[c])) for c in sorted(df.columns)) for row in df.collect())
    assert got == want and got
