"""Compare queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


def same(spark_df, con, sql: str) -> str | None:
    """None if equal as bags of rows, else what differs."""
    cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()), key=key)
    b = sorted((tuple(_norm(v) for v in r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p))) for p, q in zip(x, y))]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
