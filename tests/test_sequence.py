"""Sequence operators against row-by-row restatements."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spindle.operators import ordered as ordered_module
from spindle.operators import distribution, label, sequence
from spindle.operators.characteristic import characteristic, with_interarrival
from spindle.operators.features import feature_set
from spindle.operators.ordered import ordered
from spindle.session import GROUP_ROWS_CONF


def test_tail_state(spark, group_rows):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        part = [(g, i, rng.random() < 0.3, rng.random() < 0.4) for i in range(rng.randint(1, 40))]
        inside = False
        for _, i, s, e in part:
            inside = (not e) if inside else s
            if i == len(part) - 1:
                inside = s
            want[g, i] = int(inside)
        rows += part
    df = spark.createDataFrame(rows, "g int, i int, s boolean, e boolean").repartition(5)
    got = sequence.tail_state(ordered(df, ["g"], ["i"]), F.col("s"), F.col("e")).frame().collect()
    assert {(r.g, r.i): r.tail for r in got} == want


def test_islands_and_long_runs(spark, group_rows):
    rng = random.Random(6)
    rows = [(g, i, int(rng.random() < 0.7)) for g in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, i int, flag int").repartition(5)
    runs = {(r.g, r.i): r for r in sequence.islands(ordered(df, ["g"], ["i"]), "flag").frame().collect()}
    long = {(r.g, r.i): r.l for r in sequence.in_long_run(ordered(df, ["g"], ["i"]), "flag", 3, "l").frame().collect()}
    for g in range(4):
        flags = [f for k, _, f in rows if k == g]
        number, start = 0, 0
        for i, f in enumerate(flags):
            if i == 0 or f != flags[i - 1]:
                number, start = number + 1, i
            end = i
            while end + 1 < len(flags) and flags[end + 1] == f:
                end += 1
            assert (runs[g, i].island, runs[g, i].island_size) == (number, end - start + 1)
            assert long[g, i] == (f == 1 and end - start + 1 > 3)


def test_queue_length(spark, group_rows):
    rng = random.Random(7)
    times = sorted(rng.randint(0, 15) for _ in range(60))
    queue, want = [], []
    for t in times:
        queue = [q for q in queue if q >= t] + [t]
        want.append(len(queue))
    df = spark.createDataFrame([(0, float(t), i) for i, t in enumerate(times)], "d int, ts_submit double, id int")
    got = sequence.queue_length(df, ["d"], "id").orderBy("id").collect()
    assert [r.queue_len for r in got] == want


def test_gc_intervals(spark, group_rows):
    """The state walk: idle, idle after a write, inside."""
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(30):
        state = 0
        for i in range(rng.randint(1, 45)):
            kind = rng.choice(["write", "small", "begin", "soft", "stop", "plain"])
            hit = 0
            if kind == "write":
                state = 1 if state < 2 else 2
            elif kind in ("begin", "soft", "stop", "plain"):
                if state == 2:
                    state = 0 if kind == "stop" else 2
                elif kind == "begin" or (kind == "soft" and state == 1):
                    state = 2
                hit = int(state == 2)
            want[g, i] = hit
            rows.append((g, i, kind))
    df = spark.createDataFrame(rows, "g int, i int, kind string").repartition(5)
    kind = F.col("kind")
    got = sequence.gc_intervals(
        ordered(df, ["g"], ["i"]), kind == "begin", kind == "soft", kind == "stop", kind.isin("begin", "soft", "stop", "plain"), kind == "write"
    ).frame()
    assert {(r.g, r.i): r.reject for r in got.collect()} == want


def test_pending_and_history(spark, group_rows):
    rng = random.Random(9)
    rows = [(0, i, 10.0 * i + rng.randint(0, 5), rng.randint(0, 40000), rng.choice([0, 1, 1]), rng.choice([512, 4096, 9000])) for i in range(60)]
    events = []
    for _, i, submit, latency, io, size in rows:
        at = int(submit * 1000)
        events += [(at, i, 0), (at + latency, i, 1)]
    pending, done, seen, want = 0, [], {}, {}
    for _, i, kind in sorted(events):
        _, _, _, latency, io, size = rows[i]
        pages = int((size / 512 + 7) / 8)
        if kind == 0:
            pending += pages
            seen[i] = pending
            if io == 1 and len(done) >= 4:
                want[i] = (pending, [p for p, _ in done[-4:]], [x for _, x in done[-4:]])
        else:
            pending -= pages
            if io == 1:
                done.append((seen[i], latency))
    df = spark.createDataFrame(rows, "d int, id int, ts_submit double, latency bigint, io_type int, size bigint")
    got = sequence.pending_and_history(df, ["d"], "id")
    assert {r.id: (r.pending, r.hist_pending, r.hist_latency) for r in got.collect()} == want
    digits = sequence.digit_vector(got).first().digits
    assert len(digits) == 31 and all(0 <= d <= 9 for d in digits)


def test_interarrival_ignores_a_time_shift_and_input_order(spark, group_rows):
    rng = random.Random(10)
    rows = [(rng.randint(0, 2), i, float(rng.randint(0, 500)), rng.choice([0, 1])) for i in range(120)]
    schema = "d int, id int, ts_record double, io_type int"
    one = with_interarrival(spark.createDataFrame(rows, schema).repartition(6), ["d"], "id")
    moved = [(d, i, t + 4096.0, io) for d, i, t, io in reversed(rows)]
    two = with_interarrival(spark.createDataFrame(moved, schema), ["d"], "id")
    pick = lambda df: {r.id: (r.iat, r.read_iat, r.write_iat) for r in df.collect()}
    assert pick(one) == pick(two)
    frame = pd.DataFrame(rows, columns=["d", "id", "t", "io"]).sort_values(["t", "id"])
    want = frame.groupby("d")["t"].diff()
    got = pick(one)
    assert all((np.isnan(w) and got[i][0] is None) or got[i][0] == w for i, w in zip(frame["id"], want))


def brute_knee(values):
    x = np.array([v for v in values if np.isfinite(v)], dtype=float)
    x = np.sort(x[x <= np.percentile(x, 97)])
    grid = np.linspace(0, 1, 10_000)
    y = np.searchsorted(x / x.max(), grid, side="right") / len(x)
    i = int(np.argmax(y - grid))
    return int(grid[i] * x.max()), y[i] * 97


def test_tangent_knee(spark, group_rows):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v)) for g in range(6) for v in rng.lognormal(5, 1 + g / 4, 40 + 20 * g).round()]
    rows += [(0, float("inf"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    for r in distribution.tangent_knee(df, ["g"], {"v": F.col("v")}).collect():
        knee, percent = brute_knee([v for g, v in rows if g == r.g])
        assert abs(r.v_knee - knee) <= 1
        assert np.isclose(r.v_knee_percent, percent)


def brute_area_knee(values):
    x = np.around(np.percentile(values, range(1, 101)), 2)
    top = np.median(values) * 5
    x = np.minimum(x, top)
    y = [i * top / 100 for i in range(1, 101)]
    best, at = float("inf"), 0
    for k in range(2, 100):
        down = int(sum((y[i] + y[i + 1]) * abs(x[i + 1] - x[i]) / 2 for i in range(k)))
        right = int(sum((2 * x.max() - x[i] - x[i - 1]) * abs(y[i] - y[i - 1]) / 2 for i in range(k, 100)))
        if abs(down - right) < best:
            best, at = abs(down - right), k
    return x[at - 1], at


def test_area_knee(spark, group_rows):
    rng = np.random.default_rng(12)
    rows = [(int(g), float(v)) for g in range(4) for v in rng.lognormal(4, 0.5 + g / 3, 150).round()]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in distribution.area_knee(df, ["g"], F.col("v")).collect():
        knee, percent = brute_area_knee([v for g, v in rows if g == r.g])
        assert (r.knee, r.knee_percent) == (knee, percent)


def test_cdf_gain_of_a_small_set_is_zero(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(50)], "g int, v double")
    assert distribution.cdf_gain(df, ["g"], F.col("v"), F.col("v") < 10).first().cdf_gain == "0%"


def test_ecdf_ends_at_one_and_rises(spark, group_rows):
    rng = random.Random(13)
    df = spark.createDataFrame([(i % 3, rng.randint(0, 30)) for i in range(200)], "g int, v int")
    for g in range(3):
        y = [r.y for r in distribution.ecdf(df, ["g"], F.col("v")).where(F.col("g") == g).orderBy("x").collect()]
        assert y == sorted(y) and y[-1] == 1.0


def brute_labels(part):
    """Row-by-row labels of one chunk: (id, reject, outlier)."""
    part = sorted(part, key=lambda r: (r["ts_submit"], r["id"]))
    thr = [float(np.round(r["size"] / r["latency"])) for r in part]
    lat = [r["latency"] for r in part]
    knee_l, knee_t = brute_knee(lat)[0], brute_knee(thr)[0]
    med_l, med_t = np.percentile(lat, 50), np.percentile(thr, 50)
    n = len(part)
    drop = [round(float(np.round((thr[i - 1] if i else 0) / (thr[i] + 0.1), 1)), 1) for i in range(n)]
    start = [not (thr[i] > knee_t or lat[i] < knee_l) and drop[i] >= 1.7 for i in range(n)]
    end = [all((thr[i + j] if i + j < n else 0) >= med_t for j in range(3)) for i in range(n)]
    tail, inside = [], False
    for i in range(n):
        inside = (not end[i]) if inside else start[i]
        if i == n - 1:
            inside = start[i]
        tail.append(int(inside))
    out = [1 if t and a <= med_l and b >= med_t else 2 if not t and a > knee_l and b < med_t else 0 for t, a, b in zip(tail, lat, thr)]
    kept = [i for i in range(n) if out[i] == 0]
    k = 0
    while k < len(kept):
        j = k
        while j < len(kept) and tail[kept[j]] == tail[kept[k]]:
            j += 1
        if tail[kept[k]] and j - k <= 3:
            for i in kept[k:j]:
                out[i] = 3
        k = j
    return {r["id"]: (t, o) for r, t, o in zip(part, tail, out)}


def test_labels(spark, group_rows):
    rng = random.Random(14)
    rows = []
    for i in range(400):
        slow = (i // 15) % 3 == 0
        rows.append({
            "chunk": i // 100, "id": i, "ts_submit": float(i), "ts_record": float(i), "size": rng.choice([4096, 8192, 65536]),
            "latency": rng.randint(400, 3000) if slow else rng.randint(20, 200), "io_type": rng.choice([0, 1]),
        })
    df = spark.createDataFrame(pd.DataFrame(rows)).repartition(6)
    got = {r.id: (r.reject, r.outlier) for r in label.label_with_outliers(df, ["chunk"], ["ts_submit", "id"]).collect()}
    want = {}
    for c in range(4):
        want |= brute_labels([r for r in rows if r["chunk"] == c])
    assert got == want
    assert {o for _, o in want.values()} >= {0, 1, 3}
    kept = label.label_slow(df, ["chunk"], ["ts_submit", "id"], filter_outliers=True)
    assert {r.id for r in kept.collect()} == {i for i, (_, o) in want.items() if o == 0}


def test_features_look_back_over_chunks(spark, group_rows):
    rows = [(0, i // 20, i, float(i // 2), 4096 * (i % 5 + 1), 10 + i, i % 2, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "d int, chunk int, id int, ts_submit double, size int, latency int, io_type int, reject int")
    got = feature_set(df, ["d"], "chunk", ["ts_submit", "id"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(3, 60))
    assert all(r.prev_latency_1 == r.latency - 1 and r.prev_latency_3 == r.latency - 3 for r in got)
    assert all(r.reject == r.io_type for r in got)
    static = feature_set(df, ["d"], "chunk", ["ts_submit", "id"], rolling=False).orderBy("id").collect()
    assert [r.id for r in static] == list(range(3, 60))
    first_of = {r.chunk: r.prev_latency_1 for r in static if r.id % 20 == 0}
    assert first_of == {1: 29, 2: 29}


def test_characteristic_of_odd_windows(spark, group_rows):
    schema = "w int, event_id int, ts_record double, size bigint, offset bigint, io_type int, latency bigint"
    rows = [(0, 1, 5.0, 512, 0, 1, 0)]
    rows += [(1, i, 7.0, 1024, 4096, 0, 10) for i in range(2, 20)]
    got = {r.w: r for r in characteristic(spark.createDataFrame(rows, schema), ["w"]).collect()}
    assert (got[0].num_io, got[0].iops, got[0].iat_count, got[0].write_size_count) == (1, 0.0, 0, 0)
    assert got[0].throughput_max == float("inf")
    assert (got[1].iat_max, got[1].size_median, got[1].read_ratio, got[1].rw_ratio) == (0.0, 1024.0, 0.0, 0.0)
    empty = characteristic(spark.createDataFrame([], schema), ["w"])
    assert empty.count() == 0 and "write_throughput_p999" in empty.columns


def test_no_wider_rows_than_needed_are_written(spark, monkeypatch):
    """Columns that pending sizes are not made of stay out of the steps that are written on the way."""
    written, write = [], ordered_module.stable
    for module in (ordered_module, sequence):
        monkeypatch.setattr(module, "stable", lambda df: written.append(df.columns) or write(df), raising=False)
    spark.conf.set(GROUP_ROWS_CONF, "12")
    try:
        df = spark.range(60).selectExpr("id", "0 AS d", "id * 1.0D AS ts_submit", "id % 7 * 1000 AS latency", "4096 AS size", "1 AS io_type", "uuid() AS payload")
        rows = sequence.pending_and_history(df, ["d"], "id").collect()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert len(rows) > 40 and written and not any("payload" in columns for columns in written)
    assert sum("__pos" in columns for columns in written) == 1  # rows are put into order once
