"""Compare a query with its DuckDB SQL on the same Parquet tables."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def assert_same(df, db, sql):
    names = sorted(df.columns)
    result = db.sql(sql)
    assert sorted(result.columns) == names
    key = lambda row: tuple((x is None, str(x)) for x in row)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=key)
    assert ours == theirs
