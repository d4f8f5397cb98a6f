"""Compare registered queries with their SQL twins: python tests/check_oracles.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return format(Decimal(repr(round(v, 6))).normalize(), "f")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, queries, oracles):
    """Whether the rows are equal (None: the query ran and has no SQL to be held against)."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if name not in oracles:
        return None, f"{len(got)} rows, ran only: no SQL", seconds
    result = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", seconds
    if got != want:
        a, b = set(got), set(want)
        return False, f"{len(got)} vs {len(want)} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"[:1500], seconds
    return True, f"{len(got)} rows", seconds


def main():
    import __spark_entry__ as entry
    from postingflow.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note, seconds = compare(spark, con, sf_dir, name, queries, oracles)
        except Exception as exc:  # noqa: BLE001
            ok, note, seconds = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        if ok is False:
            failed.append(name)
        print(f"{ {True: 'ok  ', False: 'FAIL', None: 'ran '}[ok]} {name:40s} {seconds:6.2f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
