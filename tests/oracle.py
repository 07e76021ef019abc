"""Compare a query with its SQL, as sorted rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings nodes edges dag_edges registry files "
    "licenses license_list subjects subject_examples source_weights"
).split()


def connect(base: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql: str, base: str, con) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, base)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return ""
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"columns {got[0]} {want[0]}, rows {len(got[1])} {len(want[1])}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
