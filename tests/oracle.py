"""Run a query and its SQL, and compare as sets of rows with sorted columns."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def from_duckdb(sql: str, sf_dir: str) -> Counter:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter([tuple(names[i] for i in order)] + [tuple(plain(r[i]) for i in order) for r in res.fetchall()])


def from_spark(df) -> Counter:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter([tuple(names[i] for i in order)] + [tuple(plain(r[i]) for i in order) for r in df.collect()])
