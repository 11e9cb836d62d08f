"""Run registered queries beside their oracles: same names, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "∅nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want_at, have_at = [names.index(n) for n in sorted(names)], [df.columns.index(n) for n in sorted(names)]
    want = sorted(tuple(cell(row[i]) for i in want_at) for row in result.fetchall())
    have = sorted(tuple(cell(row[i]) for i in have_at) for row in df.collect())
    if len(want) != len(have):
        return f"rows {len(have)} vs {len(want)}; first {have[:2]} vs {want[:2]}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from semblance.session import local_session

    folder = sys.argv[1]
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        start = time.perf_counter()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "O" if name in oracles else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.perf_counter() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
