"""Runs a query and its SQL over the smallest test tables and compares them as bags of rows."""

import datetime
import decimal
import glob
import os

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def same_rows(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    said = db.execute(sql)
    order = [c[0] for c in said.description]
    assert sorted(order) == names
    expected = [tuple(plain(r[order.index(c)]) for c in names) for r in said.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
