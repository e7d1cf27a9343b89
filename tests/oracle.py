"""Compare registered queries with their SQL on the given tables.

    python tests/oracle.py [sf folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "-0") if v else "0"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if v is None:
        return ""
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want, want_names = rows_of(names, cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return ""


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from surco.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in oracles:
                why = compare(spark, con, folder, name, fn, oracles[name])
            else:
                n = fn(spark, folder).count()
                why = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - t:.1f}s {why}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
