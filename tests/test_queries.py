"""Every query that has SQL gives the SQL's rows on the smallest tables; the contract's names agree."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    import decimal

    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


def same(spark, name, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, SF)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), name
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([norm(x) for x in r]) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql.rstrip().rstrip(';')})").fetchall())
    assert got == want, name


def names():
    from tributary.plans import registry

    return sorted(registry.ORACLE)


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, name):
    from tributary.plans import registry

    same(spark, name, registry.QUERIES[name], registry.ORACLE[name])


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
