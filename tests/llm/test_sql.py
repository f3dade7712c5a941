"""Queries of the training-data operators against their DuckDB SQL, on the small tables and on odd rows."""

import os

import duckdb
import pytest

from traceloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_small_tables(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows(spark, odd, tmp_path, name):
    odd.drop("shard", "size").write.parquet(f"{tmp_path}/documents.parquet")
    odd.selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    same(spark, str(tmp_path), name)
