"""Runs a registered query and its SQL over the same tables and compares the rows."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(data=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def same(spark, con, query, sql, data=DATA):
    df = query(spark, data)
    names = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    cursor = con.execute(sql)
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    expected = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return len(got)
