"""Every catalogue query against the same query in DuckDB on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from spanforge.plans import catalog, models, registry, rules, scores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_template_covers_all_bytes(spark):
    """Every window of every document, non-ASCII ones too, is read whole after the prefix."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d in docs:
        s = d.text.encode()
        if len(s) >= 24:
            count = 1 if len(s) <= 488 else -(-(len(s) - 488) // 384) + 1
            for w in range(count):
                start = len(s) - 488 if w and len(s) - w * 384 < 24 else w * 384
                want.add((d.doc_id, w, hashlib.sha256(b"?name\n?value\n".ljust(24, b"\n") + s[start : start + 488]).hexdigest()))
    assert any(not d.text.isascii() for d in docs)
    assert {(r.doc_id, r.win, r.sha256) for r in registry.QUERIES["query_template_windows"](spark, SF).collect()} == want
