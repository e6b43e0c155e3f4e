import random

from pyspark.sql import functions as F

from spindle.operators import intervals, joins


def test_cover_and_ancestors_meet_once(spark):
    depth = 5
    spans = [(a, b) for a in range(32) for b in range(a - 1, 32)]
    df = spark.createDataFrame(spans, "a bigint, b bigint")
    nodes = {(r.a, r.b): r.n for r in df.select("a", "b", intervals.nodes_of_interval(F.col("a"), F.col("b"), depth).alias("n")).collect()}
    above = {r.id: r.n for r in spark.range(32).select("id", intervals.nodes_of_point(F.col("id"), depth).alias("n")).collect()}
    for (a, b), own in nodes.items():
        assert len(own) <= 2 * depth and len(set(own)) == len(own)
        assert all(len(set(own) & set(above[p])) == (a <= p <= b) for p in range(32))


def test_within_against_all_pairs(spark):
    rng = random.Random(31)
    points = [(rng.choice("ab"), rng.randrange(-3, 60), i) for i in range(200)] + [("a", None, 999)]
    spans = [(rng.choice("ab"), lo := rng.randrange(-5, 50), lo + rng.randrange(-2, 20), i) for i in range(80)] + [("a", None, 5, 80), ("b", 3, None, 81)]
    got = intervals.within(spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, lo int, hi int, s int"), ["k"], "at", "lo", "hi")
    want = {(p, s) for k, at, p in points for j, lo, hi, s in spans if k == j and None not in (at, lo, hi) and at >= 0 and lo <= at <= hi}
    rows = [(r.p, r.s) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100


def test_far_pairs_against_all_pairs(spark, group_rows):
    rng = random.Random(32)
    ends = [("a", i, rng.randrange(9)) for i in rng.sample(range(300), 120)]
    starts = [("a", i, lo := rng.randrange(280), lo + rng.randrange(-2, 90), rng.randrange(9)) for i in range(50)]
    got = intervals.far_pairs(
        spark.createDataFrame(starts, "k string, s int, lo bigint, hi bigint, g bigint"), spark.createDataFrame(ends, "k string, at bigint, h bigint"), ["k"], "lo", "hi", "at", "g", "h", 2
    )
    want = {(s, at) for _, s, lo, hi, g in starts for _, at, h in ends if lo <= at <= hi and abs(g - h) >= 2}
    rows = [(r.s, r["at"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100


def test_many_overlapping_groups(spark):
    """20,000 groups that all overlap: the work grows with groups and values, not with their product."""
    n = 20_000
    groups = spark.range(n).selectExpr("concat('g', lpad(id, 5, '0')) AS `group`", "CAST(id AS DOUBLE) AS avg", "CAST(0 - id AS DOUBLE) AS lower", "CAST(id * 2 AS DOUBLE) AS upper")
    values = [5, 19_999, 25_000, 39_998, 39_999, 0]
    got = {r.size: (r.group, r.in_interval) for r in joins.choose_group(spark.createDataFrame([(v,) for v in values], "size int"), groups).collect()}
    for v in values[:4]:
        best = min((abs(i - v), f"g{i:05d}") for i in range(n) if -i <= v <= i * 2)
        assert got[v] == (best[1], True)
    assert got[39_999][1] is False and got[0] == ("g00000", True)
