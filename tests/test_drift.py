"""Drifts against a row-by-row restatement of the definition."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import drift


def series_values(kind, n=260, seed=2):
    rng = random.Random(seed)
    level = {
        "step": lambda i: 10 if i < n // 2 else 40,
        "square": lambda i: 10 if (i // 40) % 2 == 0 else 45,
        "ramp": lambda i: 5 + i // 8,
        "flat": lambda i: 12,
        "mix": lambda i: 10 if i < 60 else (40 if i < 90 or 130 < i < 150 else 10) if i < 180 else 42,
    }[kind]
    return [float(level(i) + (rng.randint(-6, 6) if rng.random() < 0.3 else rng.randint(-1, 1))) for i in range(n)]


class Walk:
    """The definition, one row at a time."""

    def __init__(self, values, s):
        self.s, n = s, len(values)
        self.g = [0 if v < 0 else 1 if v - 1 <= s.offset else int((v - s.offset) / s.threshold) + 2 for v in values]
        self.mode = [Counter(self.g[max(0, i - s.window) : i + 1]) for i in range(n)]
        self.high = [min(c, key=lambda k: (-c[k], k)) for c in self.mode]
        half = s.window // 2
        self.st, self.sg = [0], [0]
        for i in range(1, n):
            c, g = self.mode[i], self.g[i]
            ahead = Counter(self.g[i : i + s.window])
            calm = sum(c.values()) < s.window or (c[g] > half and ahead[g] > half)
            calm = calm or self.mode[i - 1][self.g[i - 1]] > half or sum(c[g + d] for d in (-2, -1, 1, 2)) > half
            self.st.append(self.st[-1] + 1 if calm else 0)
            self.sg.append(self.sg[-1] + 1 if g == self.g[i - 1] else 0)

    def mass(self, i, m):
        return sum(self.mode[i][m + d] for d in (-1, 0, 1))

    def near_before(self, at, m):
        return next((i for i in range(at, 0, -1) if self.g[i] == m), at)

    def run_start(self, at, m):
        return next((i for i in range(at, 0, -1) if self.g[i] == m and self.g[i - 1] != m), at)

    def run_end(self, at, m):
        return next((i for i in range(at, len(self.g) - 1) if self.g[i] == m and self.g[i + 1] != m), at)

    def drifts(self):
        s, half, n = self.s, self.s.window // 2, len(self.g)
        ends = [i for i in range(n - 1) if self.st[i] >= s.stability and self.st[i + 1] == 0]
        recurring, others = [], []
        for a, i in enumerate(ends):
            for j in ends[a + 1 :]:
                if j - (i - self.st[i]) >= s.reach:
                    break
                start, m = i, self.high[i]
                if self.g[i - self.st[i]] == m:
                    start = i - self.st[i]
                elif self.g[i] != m:
                    start = self.run_start(self.near_before(i, m), m)
                a_mode, b_mode = self.high[start], self.high[j]
                if a_mode == b_mode:
                    end = j if self.g[j] == a_mode else self.near_before(j, a_mode)
                    if sum(self.mass(k, a_mode) < half for k in range(start + 1, j)) > s.recurring_rows:
                        recurring.append((start, self.run_end(end, a_mode), "recurring"))
                elif abs(a_mode - b_mode) > 1:
                    pieces, begin = [], None
                    for k in range(i + 1, j):
                        heavy = self.mass(k, b_mode) >= half
                        if heavy and begin is None:
                            begin = k
                        if not heavy and begin is not None:
                            pieces.append((begin, k))
                            begin = None
                    if begin is not None:
                        pieces.append((begin, j))
                    merged = 0
                    for k, (b, _) in enumerate(pieces):
                        merged += k == 0 or b - pieces[k - 1][1] > s.window
                    kind = "gradual" if merged > 1 else "sudden" if abs(a_mode - b_mode) > (2 if 0 in (a_mode, b_mode) else 1) else "incremental"
                    others.append((self.run_start(start, a_mode), self.run_end(j, b_mode), kind))
        starts = {r[0] for r in recurring}
        return sorted(recurring + [o for o in others if o[2] != "sudden" or o[0] not in starts])


SETTINGS = drift.DriftSettings(threshold=3, offset=3, stability=6, reach=150)


def test_drifts(spark, group_rows):
    data = {k: series_values(k) for k in ("step", "square", "ramp", "flat", "mix")}
    rows = [(k, i, v) for k, values in data.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, idx bigint, value double").repartition(5)
    states = {(r.series, r.idx): r for r in drift.stability(df, SETTINGS).collect()}
    want = []
    for k, values in data.items():
        walk = Walk(values, SETTINGS)
        for i in range(len(values)):
            r = states[k, i]
            assert (r.group, r.mode, r.stability, r.stability_group) == (walk.g[i], walk.high[i], walk.st[i], walk.sg[i])
        want += [(k, *d) for d in walk.drifts()]
    got = [(r.series, r.start, r.end, r.type) for r in drift.find_drifts(df, SETTINGS).collect()]
    assert sorted(got) == sorted(want)
    assert {w[3] for w in want} >= {"recurring", "sudden"}


def test_merge_intervals(spark, group_rows):
    rng = random.Random(4)
    spans = sorted({(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 400) for _ in range(60))})
    merged = []
    for s, e in spans:
        if merged and s - merged[-1][1] <= 3:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    df = spark.createDataFrame([("x", s, e) for s, e in spans], "k string, start bigint, `end` bigint")
    assert sorted([r.start, r.end] for r in drift.merge_intervals(df, ["k"], 3).collect()) == merged


def pair_score(x):
    return sum(np.sign(x[j] - x[i]) for i in range(len(x)) for j in range(i + 1, len(x)))


def test_mann_kendall(spark, group_rows):
    rng = random.Random(15)
    data = {g: [max(0, rng.randint(0, 6) + (i // 6 if g % 2 else 0)) for i in range(40)] for g in range(4)}
    df = spark.createDataFrame([(g, i, v) for g, x in data.items() for i, v in enumerate(x)], "g int, i int, v int")
    for r in drift.mann_kendall(df, ["g"], "i", "v").collect():
        x = data[r.g]
        assert r.s == pair_score(x)
        n, ties = len(x), sum(t * (t - 1) * (2 * t + 5) for t in Counter(x).values())
        z = (r.s - np.sign(r.s)) / np.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18)
        assert np.isclose(r.z, z)
        from math import erfc, sqrt

        assert abs(r.p - erfc(abs(z) / sqrt(2))) < 1e-6
        assert r.trend == ("no trend" if r.p >= 0.05 else "increasing" if z > 0 else "decreasing")


def greedy(modes, least, alpha=0.05):
    from math import erfc, sqrt

    def trending(x):
        runs = [v for i, v in enumerate(x) if i == 0 or v != x[i - 1]]
        if x[0] == x[-1]:
            return False
        up = x[0] < x[-1]
        if any((b - a < -1) if up else (b - a > 1) for a, b in zip(runs, runs[1:])):
            return False
        s, n = pair_score(x), len(x)
        var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in Counter(x).values())) / 18
        return s != 0 and erfc((abs(s) - 1) / sqrt(var) / sqrt(2)) < alpha

    found, i = [], 0
    while i < len(modes):
        for j in range(i + least + 1, len(modes)):
            if trending(modes[i:j]):
                found.append((i, j))
                i = j
                break
        i += 1
    return found


def test_trending_segments(spark):
    rng = random.Random(16)
    modes = [3 + i // 9 + rng.randint(0, 1) if i < 60 else 9 - (i - 60) // 7 + rng.randint(0, 1) for i in range(110)]
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(modes)], "series string, idx bigint, mode int")
    got = sorted((r.start, r.end) for r in drift.trending_segments(df, min_length=8, slot_rows=60).collect())
    assert got == greedy(modes, 8)


def test_trending_segments_longer_than_a_slot(spark):
    rng = random.Random(17)
    modes = [3 + i // 60 + rng.randint(0, 1) for i in range(90)] + [4] * 60 + [9, 2] + [5 - i // 9 for i in range(45)]
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(modes)], "series string, idx bigint, mode int")
    for slot_rows in (5, 13, 1000):
        got = sorted((r.start, r.end) for r in drift.trending_segments(df, min_length=8, slot_rows=slot_rows).collect())
        assert got == greedy(modes, 8)
    assert drift.trending_segments(df.limit(0)).collect() == []


def monotone(modes):
    """The two flags, step by step: the step that ends a rise is not held against falling."""
    up = down = True
    for a, b in zip(modes, modes[1:]):
        if up:
            up = b > a
        elif down:
            down = b < a
    return up, down


def test_monotone_between_steps(spark):
    rng = random.Random(19)
    modes = [3, 5, 5, 4, 2, 1] + [rng.randint(1, 4) for _ in range(60)]
    rows = spark.createDataFrame([("a", i, m) for i, m in enumerate(modes)], "series string, idx bigint, mode int")
    spans = [(i, j) for i in range(len(modes)) for j in range(i + 1, min(i + 9, len(modes)))]
    got = drift.monotone_between(spark.createDataFrame([("a", i, j) for i, j in spans], "series string, s bigint, e bigint"), rows, "s", "e").collect()
    assert {(r.s, r.e): (r.is_increasing, r.is_decreasing) for r in got} == {(i, j): monotone(modes[i : j + 1]) for i, j in spans}
    assert monotone(modes[:6]) == (False, True)


def first_finder(rows, s):
    """The first finder over all pairs of ends."""
    n = len(rows)
    ends = [i for i in range(n - 1) if rows[i].stability >= s.stability and rows[i + 1].stability == 0]
    group, mode = [r.group for r in rows], [r["mode"] for r in rows]
    starts = {}
    for e in ends:
        at = e - rows[e].stability
        start = next((i for i in range(at, 0, -1) if group[i] == group[at] and group[i - 1] != group[at]), at)
        starts[start] = min(starts.get(start, e), e)
    found = []
    for start, end_a in starts.items():
        for e in ends:
            if e <= end_a or e - start < s.min_length:
                continue
            if mode[start] == mode[e]:
                steady = [i for i in range(start, e) if rows[i].stability > 0 and group[i] == group[start] and rows[i].stability_group > s.stability]
                if group[start] == group[e] or steady:
                    found.append((start, e if group[start] == group[e] else steady[-1], "recurring"))
                    break
            elif any(monotone(mode[start : e + 1])):
                found.append((start, e, "incremental"))
            elif abs(group[start] - group[e]) >= 2:
                found.append((start, next((i for i in range(e, n - 1) if group[i] == group[e] and group[i + 1] != group[e]), e), "sudden"))
    return sorted(found)


def test_first_finder_has_no_longest_drift(spark):
    rng = random.Random(18)
    long = [float((5, 400, 5, 900, 400)[i // 2500 % 5]) for i in range(12_000)]
    mixed = [float(rng.choice((1, 40, 80, 200)) if i % 40 == 0 else 0) for i in range(900)]
    for i in range(1, 900):
        mixed[i] = mixed[i] or mixed[i - 1]
    settings = drift.DriftSettings(threshold=30, offset=30, stability=6, min_length=10)
    df = spark.createDataFrame([(k, i, v) for k, x in (("long", long), ("mixed", mixed)) for i, v in enumerate(x)], "series string, idx bigint, value double")
    states = drift.stability_v1(df, settings).orderBy("series", "idx").collect()
    got = drift.find_drifts_v1(df, settings).collect()
    for k in ("long", "mixed"):
        assert sorted((r.start, r.end, r.type) for r in got if r.series == k) == first_finder([r for r in states if r.series == k], settings)
    assert any(r.end - r.start > 3600 for r in got)


def test_first_finder_forms_only_pairs_that_become_drifts(spark, monkeypatch):
    """Thousands of ends that never return: what is joined is what is found."""
    from spindle.operators import intervals

    level = [1 + 30 * (i // 8) for i in range(16_000)]  # 2000 plateaus, each higher than all before
    settings = drift.DriftSettings(threshold=30, offset=30, stability=3, min_length=4)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(level)], "series string, idx bigint, value double")
    ends = drift.concept_ends(drift.stability_v1(df, settings), settings).count()
    formed = []
    whole = drift.far_pairs
    monkeypatch.setattr(drift, "far_pairs", lambda *a: formed.append(whole(*a)) or formed[-1])
    found = drift.find_drifts_v1(df, settings)
    kinds = {r["type"]: r.n for r in found.groupBy("type").agg(F.count("start").alias("n")).collect()}
    assert ends > 1900 and formed[0].count() == kinds.get("sudden", 0) and intervals.depth_for(15_999) == 14


def test_slices(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "series string, idx bigint, value double")
    found = spark.createDataFrame([("a", 5, 12, "sudden"), ("a", 10, 10, "gradual")], "series string, start bigint, `end` bigint, type string")
    open_ = drift.slice_drifts(rows, found).groupBy("type").agg(F.count("idx").alias("n")).collect()
    assert {r.type: r.n for r in open_} == {"sudden": 7}
    closed = drift.slice_drifts(rows, found, closed=True).groupBy("type").agg(F.count("idx").alias("n")).collect()
    assert {r.type: r.n for r in closed} == {"sudden": 8, "gradual": 1}


@pytest.mark.parametrize("value, want", [(-1.0, 0), (0.0, 1), (51.0, 1), (51.5, 2), (299.0, 2), (300.0, 3), (1000.0, 5)])
def test_value_group(spark, value, want):
    from spindle.functions.scalars import value_group

    assert spark.range(1).select(value_group(F.lit(value), 250.0, 50.0).alias("g")).first().g == want
