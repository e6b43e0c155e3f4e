"""Windows that start anew after a gap, against the steps one by one."""

import random

from spindle.operators.restarts import reached, restarted_windows
from spindle.plans import windows
from tests.conftest import SF

SCHEMA = "k string, ts_record double, size long, g long"


def slow(rows, width_ms, tolerance_s):
    """(k, window, ts) of all records within windows."""
    found = []
    for key in {r[0] for r in rows}:
        times = sorted({round(r[1] * 10) for r in rows if r[0] == key and r[1] is not None})
        width, held, start, window = width_ms * 10, [], None, 0
        while times:
            start = times[0] if start is None or times[0] >= start + width else start
            picked = [t for t in times if t < start + width]
            times = times[len(picked) :]
            held = [t for t in held + picked if t >= picked[-1] - width]
            if abs(held[-1] - held[0] - width) <= tolerance_s * 10_000:
                inside = [r for r in rows if r[0] == key and r[1] is not None and held[0] <= round(r[1] * 10) <= held[-1]]
                found += [(key, window, r[1], r[2]) for r in inside]
                window, held = window + 1, []
            start = picked[-1] + 1
    return sorted(found, key=repr)


def test_against_the_steps(spark, group_rows):
    rng = random.Random(9)
    rows = []
    for key, n, step in (("dense", 120, 400), ("gaps", 90, 900), (None, 40, 1500), ("one", 1, 1)):
        at = rng.uniform(0, 10_000)
        for _ in range(n):
            at += rng.expovariate(1 / step) + (rng.uniform(2000, 30_000) if key == "gaps" and rng.random() < 0.1 else 0)
            rows.append((key, round(at, 1), rng.randint(1, 9), 7))
    rows += rows[:20]  # repeated rows
    rows += [("dense", None, 1, 7), (None, None, 1, 7)]
    rng.shuffle(rows)
    got = restarted_windows(spark.createDataFrame(rows, SCHEMA), ["k"], 5000, tolerance_s=0.4)
    assert sorted([(r["k"], r["window_id"], r["ts_record"], r["size"]) for r in got.collect()], key=repr) == slow(rows, 5000, 0.4)
    assert len({r[:2] for r in slow(rows, 5000, 0.4)}) > 10


def test_empty(spark):
    assert restarted_windows(spark.createDataFrame([], SCHEMA), ["k"], 5000).count() == 0


def test_reached(spark):
    edges = spark.createDataFrame([(1, i, i + 3) for i in range(0, 100)] + [(2, 5, None)], "g long, node long, to long")
    roots = spark.createDataFrame([(1, 1), (2, 5), (3, 9)], "g long, node long")
    got = sorted(tuple(r) for r in reached(edges, roots).collect())
    assert got == [(1, n) for n in range(1, 101, 3)] + [(2, 5), (3, 9)]


def test_query_hands_on_no_column_it_does_not_need(spark, monkeypatch):
    seen, restarted = [], windows.restarted_windows
    monkeypatch.setattr(windows, "restarted_windows", lambda df, *rest, **more: seen.append(df.columns) or restarted(df, *rest, **more))
    windows.restarted(spark, SF).schema
    assert [sorted(c) for c in seen] == [["disk_id", "size", "ts_record"]]
