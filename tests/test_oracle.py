"""Every query with SQL gives DuckDB's rows."""

import datetime
import math

import duckdb
import pytest

from quire import queries as reference

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_same_rows(spark, duck, name):
    compare(spark, duck, reference.queries()[name], reference.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(reference.queries()) - set(reference.oracle_sql())))
def test_runs(spark, name):
    assert reference.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(reference.queries()) <= set(entry.queries())
