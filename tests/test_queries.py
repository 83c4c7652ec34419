"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from ledgerloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted("|".join(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted("|".join(plain(r[c]) for c in order) for r in got) == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["pub_id", "eid", "title", "year"] and df.count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
