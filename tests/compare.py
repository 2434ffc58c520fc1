"""Row comparison with DuckDB, whatever the order and the integer widths."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return repr(round(float(x), 5) + 0.0)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(db, sql):
    found = db.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())
