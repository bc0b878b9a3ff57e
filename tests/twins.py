"""A query and its SQL, run on the same tables and compared row by row."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def compare(spark, sf, run, sql):
    df = run(spark, sf)
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted(tuple(plain(row[c]) for c in order) for row in df.collect())
    at = [cols.index(c) for c in order]
    b = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    assert a == b
