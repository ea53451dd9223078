"""Comparison of a query's rows with its SQL's over the same tables."""

import datetime
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 1e-9 else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def by_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.sql(sql)
    return list(found.columns), found.fetchall()


def compare(df, sql: str, sf_dir: str) -> None:
    names, rows = by_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
