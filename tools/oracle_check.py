"""Run queries and their SQL side by side: python tools/oracle_check.py [sf] [name-part ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spindle.plans import ORACLES, QUERIES  # noqa: E402
from spindle.session import GROUP_ROWS_CONF, build_session  # noqa: E402


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    return f"{type(value).__name__}:{value!r}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", cores=8)
    if os.environ.get("GROUP_ROWS"):  # a small value sends every query through the split-group path
        spark.conf.set(GROUP_ROWS_CONF, os.environ["GROUP_ROWS"])
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark: {str(error)[:1500]}")
            continue
        took = time.time() - began
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows {took:.1f}s")
            continue
        try:
            cursor = con.execute(ORACLES[name])
            columns = [d[0] for d in cursor.description]
            want = cursor.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql: {str(error)[:800]}")
            continue
        if sorted(columns) != sorted(df.columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(set(columns) ^ set(df.columns))}")
            continue
        a, b = rows_of(df.columns, got), rows_of(columns, want)
        if a != b:
            bad += 1
            print(f"FAIL {name}: {len(got)} vs {len(want)} rows")
            names = sorted(df.columns)
            left, right = sorted((a - b).elements()), sorted((b - a).elements())
            print(f"     {len(left)} and {len(right)} rows differ; columns that differ in the first rows:")
            for x, y in list(zip(left, right))[:4]:
                print("    ", [f"{n}: {u} | {v}" for n, u, v in zip(names, x, y) if u != v][:8])
            if len(left) != len(right):
                for extra in (left, right):
                    print("    ", [dict(zip(names, r)) for r in extra[:2]])
            continue
        print(f"ok   {name}: {len(got)} rows {took:.1f}s", "" if got else "EMPTY")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
