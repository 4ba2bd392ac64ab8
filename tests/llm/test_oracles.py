"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels".split()


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(str([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.sql(ORACLE[name])
    assert normal(df.columns, df.collect()) == normal(want.columns, want.fetchall())
