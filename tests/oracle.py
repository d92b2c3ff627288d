"""A query of Spark against its SQL in DuckDB, row by row."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if glob.glob(path + '/*.parquet') else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def assert_same(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    answer = connect(folder).execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, answer.fetchall())
