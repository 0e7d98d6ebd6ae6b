"""Queries of the operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from spanforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
