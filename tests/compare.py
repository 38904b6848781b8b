"""Run a query and its SQL on the same tables and compare whole results.

``python tests/compare.py [--sf DIR] [name ...]`` checks the named queries, or all of them.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    return str(v)


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([normal(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got_names, got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    odd = [(r[0], r[1]) for r in con.execute("describe " + sql).fetchall()
           if "HUGEINT" in r[1] or "NULL" in r[1] or r[1].startswith("DECIMAL")]
    if odd:
        return False, f"SQL types without a Spark twin: {odd}"
    cur = con.execute(sql)
    want_names, want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{len(got)} vs {len(want)} rows, first differences: {bad}"
    return len(got) > 0, f"{len(got)} rows"


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf_dir, argv = argv[1], argv[2:]
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from fleetpulse import get_session
    from fleetpulse.registry import catalog

    catalog.load_all()
    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    names = [n for n in catalog.QUERIES if not argv or any(n == a or n.startswith(a) for a in argv)]
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, catalog.QUERIES[name], catalog.SQL.get(name), sf_dir)
        except Exception as exc:  # report every query, then fail
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
