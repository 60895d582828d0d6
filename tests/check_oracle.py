"""Compare registered queries with their SQL twins in DuckDB.

    python tests/check_oracle.py [sf0.01] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry_module
from terraframe import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, folder: str, name: str, run, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(rows)} spark={t1 - t0:.2f}s (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    expected = cur.fetchall()
    t2 = time.time()
    note = f"rows={len(rows)}/{len(expected)} spark={t1 - t0:.2f}s duckdb={t2 - t1:.2f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = canonical(df.columns, rows), canonical(cols, expected)
    if a == b:
        return True, note
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{note} differ in {sum(x != y for x, y in zip(a, b))}: {sorted(cols)} {diff}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    wanted = sys.argv[2:]
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name in wanted or queries:
        try:
            good, note = compare(spark, con, folder, name, queries[name], oracle.get(name))
        except Exception as e:  # report and go on with the next query
            good, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not good
        print(("ok  " if good else "FAIL"), name, note, flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())
