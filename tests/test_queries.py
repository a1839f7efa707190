"""Every query with SQL against DuckDB on the small tables; the others run."""

import math

import duckdb
import pytest

from landshift.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got, columns = [r.asDict() for r in df.collect()], sorted(df.columns)
    if name not in registry.ORACLES:
        return
    answer = duck.sql(registry.ORACLES[name])
    assert sorted(answer.columns) == columns
    want = [dict(zip(answer.columns, r, strict=True)) for r in answer.fetchall()]
    flat = lambda rows: sorted(str([plain(r[c]) for c in columns]) for r in rows)
    assert flat(got) == flat(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
