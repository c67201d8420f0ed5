"""Text queries with SQL give what DuckDB gives on the small tables."""

import duckdb
import pytest

from wellspring.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(tuple(dict(zip(names, r))[c] for c in cols)) for r in cur.fetchall())
