"""Comparing results and running SQL over the test tables."""

import glob
import os
from decimal import Decimal

DATA = "/root/testdata"


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def same_as_sql(df, sql, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        where = path if os.path.isfile(path) else f"{path}/*.parquet"
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{where}'")
    want = db.execute(sql)
    assert table_of(df.collect(), df.columns) == table_of(want.fetchall(), [c[0] for c in want.description])
