"""The queries that SQL can express against DuckDB on the small tables."""

import duckdb
import pytest

from landshift.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = want.project(", ".join(columns)).fetchall()
    assert sorted(map(str, got.select(columns).rdd.map(tuple).collect())) == sorted(map(str, rows)) and rows


def test_decontamination_sql_holds_short_items(spark, tmp_path):
    """Items of one to four words, and longer ones, against the SQL of op2."""
    docs = [(k, f"one {k} two, Three four five six seven eight; nine ten{k}") for k in range(6)] + [(7, None), (8, "two"), (9, "two two three two three")]
    items = [(1, "two"), (2, "Two three"), (3, "three four five six"), (4, "four five six seven eight nine"), (5, "?!"), (6, None), (7, "ten3"), (8, "nine ten 3"), (9, "two three two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    columns = ["doc_id", "item_id", "containment", "first_word"]
    want = duck.sql(oracles.OP2).project(", ".join(columns)).fetchall()
    got = queries.op2_decontamination(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[1] for r in want} == {1, 2, 3, 4, 7, 9}
