"""Compares a registered query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(row[k]) for k in order)) for row in rows)


def same(spark, query, sql, sf_dir):
    """Asserts that both give the same columns and rows."""
    df = query(spark, sf_dir)
    with duckdb.connect() as con:
        for name in TABLES:
            if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        want = found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want)
