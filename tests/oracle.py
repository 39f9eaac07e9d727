"""Runs a query and its SQL over the same tables and compares them."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def database(folder: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(r[c]) for c in names]) for r in df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    order = sorted((d[0], k) for k, d in enumerate(cursor.description))
    return [n for n, _ in order], sorted(str([plain(r[k]) for _, k in order]) for r in cursor.fetchall())
