"""Holds a Spark result against DuckDB's for the same tables."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def _order(row):
    return [(v is None, "number" if isinstance(v, (int, float)) else "text", f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g} {v}" if isinstance(v, int) else str(v)) for v in row]


def rows(names, found):
    """Rows with their columns in order of their names, sorted; numbers stay what they are."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in at) for r in found), key=_order)


def alike(a, b):
    """Whole numbers, texts and the rest exactly; floats but for their last digits."""
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def spark_rows(df):
    return rows(df.columns, df.collect())


def same(spark_df, con, sql):
    want = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(want.columns)
    a, b = spark_rows(spark_df), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(alike, x, y))]
    assert not wrong, (len(wrong), wrong[:3])
