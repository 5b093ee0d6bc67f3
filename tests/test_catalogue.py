"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in cur.description]
        want = cur.fetchall()
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want)


def test_whole_memory_is_imported(spark, duck):
    n = duck.execute("SELECT count(*) FROM conversations WHERE turn % 3 <> 0 AND trim(text) <> '' AND trim(role) <> ''").fetchone()[0]
    assert catalogue.QUERIES["memory_import_whole"](spark, SF).count() == n > 200
