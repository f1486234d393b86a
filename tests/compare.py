"""Compare a query with its SQL on one scale factor, as the driver does."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr), dict(zip(rel.columns, map(str, rel.types)))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def same(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols, got = rows_of(df)
    want_cols, want, types = sql_rows(con, sql)
    assert cols == want_cols, name
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == types, name
    assert len(got) == len(want), (name, len(got), len(want))
    assert got == want, (name, [x for x in zip(got, want) if x[0] != x[1]][:3])
    return len(got)
