"""Every query of the engine against its SQL."""

import math

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    assert normal(got) == normal(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["c_name", "c_mktsegment"] and df.count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
