"""Side-by-side comparison of a registered query with its DuckDB statement."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value if isinstance(value, (int, str)) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, statement: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(names, cursor.fetchall())
    if left == right:
        return None
    a, b = set(map(repr, left)), set(map(repr, right))
    return (f"{len(left)} vs {len(right)} rows; columns {sorted(names)}; only spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}")
