import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import oracles, queries

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in oracles.SQL:
        r = con.execute(oracles.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
