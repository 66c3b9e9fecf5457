"""Run a registered query next to its oracle SQL on the same Parquet files."""

from __future__ import annotations

import math
import time

from talus.plans.adapters import TABLES


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "\x00"
    if isinstance(value, float):
        return "\x00" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> dict:
    """Differences between the two engines; empty ``problem`` means equal."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    problem = ""
    if sorted(names) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif any("HUGEINT" in k or "DECIMAL" in k for k in kinds.values()):
        problem = f"wide oracle types {kinds}"
    elif len(got) != len(want):
        problem = f"{len(got)} rows != {len(want)}"
    else:
        a, b = _rows(df.columns, got), _rows(names, want)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problem = f"{len(bad)} rows differ, first {bad[0]}"
    return {"rows": len(got), "seconds": round(seconds, 2), "problem": problem}
