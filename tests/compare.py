"""Comparing a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of_sql(sql, data=DATA):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
