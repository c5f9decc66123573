"""Compare a query's rows with those that DuckDB gives for its SQL."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), ordered([tuple(plain(r[i]) for i in at) for r in cur.fetchall()])


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered([tuple(plain(r[n]) for n in names) for r in df.collect()])
