"""Spark's rows against DuckDB's for a query with SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(map(str, r))) for r in df.select(*(f"`{c}`" for c in cols)).collect())


def duck_rows(sql, path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(repr(tuple(str(r[i]) for i in at)) for r in cur.fetchall())
