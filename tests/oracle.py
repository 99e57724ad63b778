"""Runs registered queries next to their SQL and compares the rows.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    left, right = canonical(df.columns, got), canonical(names, want)
    if left != right:
        in_left, in_right = set(left), set(right)
        only_l = [r for r in left if r not in in_right][:3]
        only_r = [r for r in right if r not in in_left][:3]
        cut = lambda rs: "\n      ".join(str(r)[:700] for r in rs)
        return False, f"{len(left)} vs {len(right)} rows\n   spark only:\n      {cut(only_l)}\n   sql only:\n      {cut(only_r)}"
    types = {n: str(t) for n, t in zip(names, [d[1] for d in cur.description])}
    loose = [n for n, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    return True, f"{len(got)} rows, {took:.1f}s" + (f", loose types {loose}" if loose else "")


def main() -> int:
    from feedlens.session import build_session
    from feedlens.workload import load

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = load()
    spark = build_session(
        "oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
