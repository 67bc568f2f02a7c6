"""Compare a query with its DuckDB statement on the smallest test data."""

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"
HAVE_DATA = Path(DATA).exists()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    return got, want
