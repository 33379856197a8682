"""A query's rows against its SQL in DuckDB, over the same Parquet tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, query, sql):
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    df = query(spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, found.fetchall())
