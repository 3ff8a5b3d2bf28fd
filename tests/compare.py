"""Compare a Spark result with its reference SQL: names, types and every value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "inf" if math.isinf(v) else ("nan" if math.isnan(v) else v + 0.0)
    return v


def _sorted(rows, order):
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[name].upper():
            out.append(f"type of {name}: {kind} vs {kinds[name]}")
    ours = df.collect()
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
        return out
    columns = sorted(names)
    a = _sorted(ours, [df.columns.index(c) for c in columns])
    b = _sorted(theirs, [names.index(c) for c in columns])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cells = [(c, p, q) for c, p, q in zip(columns, x, y) if p != q]
        out.append(f"{len(bad)} rows differ, e.g. {cells[:4]}")
    return out
