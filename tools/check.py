"""Compare registered queries with their SQL: ``python tools/check.py [sf_dir] [name ...]``.

Rows are compared as multisets with columns sorted by name; values must be equal as text.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def as_text(value) -> str:
    return repr(bytes(value)) if isinstance(value, (bytes, bytearray)) else repr(value)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(as_text(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    expected_rows = got.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine, theirs = bag(df.columns, rows), bag(columns, expected_rows)
    if mine != theirs:
        extra, lacking = mine - theirs, theirs - mine
        return False, (f"{len(rows)} rows, expected {len(expected_rows)}; {sum(extra.values())} extra "
                       f"e.g. {sorted(extra)[:3]}; {sum(lacking.values())} missing e.g. "
                       f"{sorted(lacking)[:3]}; columns {sorted(columns)}")
    return True, f"{len(rows)} rows, {took:.1f}s"


def main() -> int:
    from veilstream.session import build_session
    from workload import registered
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = registered()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            ok, text = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name + ": " + text, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
