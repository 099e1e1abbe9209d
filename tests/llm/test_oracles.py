"""The corpus queries that have SQL, held against DuckDB."""

import duckdb
import pytest

from strideline.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(c[0] for c in got.description)
    names = [c[0] for c in got.description]
    want = sorted(tuple(str(dict(zip(names, r))[k]) for k in cols) for r in got.fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == cols
    assert sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == want
