"""Runs a query and its SQL side by side, as rows with columns in order of name."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, df.collect())


def sql_rows(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            p = Path(sf_dir, f"{t}.parquet")
            c.execute(f"create view {t} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
        found = c.execute(sql)
        return rows([x[0] for x in found.description], found.fetchall())
