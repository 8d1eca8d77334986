"""Compare a query with its oracle: columns by name, rows in any order."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def differences(df, folder: str, sql: str) -> str | None:
    names, rows = oracle_rows(folder, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    ours = sorted(repr(tuple(_plain(r[c]) for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(_plain(r[names.index(c)]) for c in order)) for r in rows)
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} vs {len(theirs)} rows; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
