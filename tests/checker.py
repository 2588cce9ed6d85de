"""Compare registered queries with their oracle SQL: names, row counts and values.

    python tests/checker.py [sf] [key-pattern]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", v)
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v.isoformat())
    if v is None:
        return ("0", "")
    return ("s", str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    o_names = [d[0] for d in cur.description]
    o_types = dict(zip(o_names, [str(d[1]) for d in cur.description]))
    want_names, want = _rows(o_names, cur.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    types = [f"{f.name}: {f.dataType.simpleString()} != {o_types[f.name]}" for f in df.schema.fields
             if _TYPES.get(f.dataType.simpleString()) != o_types[f.name]]
    if types:
        return "types " + "; ".join(types)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(n, a[1], b[1]) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {diff[:4]} in {g}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from touchline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    path = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(path)
    oracles, failed = oracle_sql(), 0
    for key, fn in queries().items():
        if not pattern.search(key):
            continue
        start = time.time()
        try:
            df = fn(spark, path)
            if key in oracles:
                problem = compare(df, con, oracles[key])
                n = ""
            else:
                n = f"{len(df.collect())} rows, no oracle"
                problem = None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
            if "invalidated" in str(e) or "INTERNAL" in str(e):
                con = connect(path)
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s {n}{problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
