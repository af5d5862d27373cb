"""Runs registered queries beside their check SQL: same columns, types, and rows in any order."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, query, sql: str, folder: str) -> str:
    """Empty text if all agrees, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    spark_kinds = dict(df.dtypes)
    off = {c: (spark_kinds[c], kinds[c]) for c in names if TYPES.get(kinds[c], kinds[c]) != spark_kinds[c]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    from salesloom.session import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__checkpoint__dir=os.environ.get("SPARK_SHARED", "/tmp/shared"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = entry.oracle_sql()
    failed = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                msg = compare(spark, con, entry.queries()[n], sqls[n], folder)
            else:
                msg = "" if entry.queries()[n](spark, folder).count() > 0 else "no rows"
                n += " (rows only)"
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed", failed)
    spark.stop()
