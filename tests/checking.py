"""Compare a Spark result with the same query's SQL result on a second engine."""

from __future__ import annotations

import datetime

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def second_engine(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(plain(r[i]) for i in order) for r in rows]


def differences(got, want):
    """The first few differing rows, or an empty list."""
    (gn, gr), (wn, wr) = got, want
    if gn != wn:
        return [("columns", gn, wn)]
    if len(gr) != len(wr):
        return [("rows", len(gr), len(wr))]
    out = []
    for a, b in zip(sorted(gr, key=lambda r: [str(x) for x in r]), sorted(wr, key=lambda r: [str(x) for x in r])):
        if a != b:
            out.append((a, b))
    return out[:5]
