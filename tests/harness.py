"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):  # Decimal
        return float(v)
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    wi = [names.index(n) for n in order]
    gi = [df.columns.index(n) for n in order]
    got_rows = df.collect()
    got = Counter(tuple(plain(r[i]) for i in gi) for r in got_rows)
    want = Counter(tuple(plain(r[i]) for i in wi) for r in want_rows)
    if got == want:
        g0 = next(iter(got_rows), None)
        w0 = next(iter(want_rows), None)
        if g0 is not None:
            for n, a, b in zip(order, gi, wi):
                if type(g0[a]) is not type(w0[b]) and g0[a] is not None and w0[b] is not None:
                    return f"type of {n}: {type(g0[a])} vs {type(w0[b])}"
        return None
    return (
        f"rows {len(got_rows)} vs {len(want_rows)}; only here {list((got - want).items())[:2]}; "
        f"only in SQL {list((want - got).items())[:2]}"
    )
