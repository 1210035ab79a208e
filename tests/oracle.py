"""Run one registered query on Spark and its SQL on DuckDB, and compare."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, int):
        return ("n", str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return ("", "")
        return ("f", repr(value + 0.0))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got, got_cols = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first extra: {next((g for g, w in zip(got, want) if g != w), None)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    return None
