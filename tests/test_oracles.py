"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from wellspring.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These want the grids that tables of 60 000 rows have.
LARGER = {"p18_montage", "p26_stitch_labels_3d", "s12_transpose_wide"}
BIG = os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = {SF: duckdb.connect(), BIG: duckdb.connect()}
    for sf, c in con.items():
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.8g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    sf = BIG if name in LARGER else SF
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = db[sf].execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(norm(dict(zip(names, r))[c]) for c in cols)) for r in cur.fetchall())
    assert got == want
