"""Rows of Spark and of DuckDB in one comparable shape."""

import datetime
import decimal


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return str(v)


def of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)


def of_duck(duck, sql):
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(([plain(r[i]) for i in at] for r in got.fetchall()), key=repr)
