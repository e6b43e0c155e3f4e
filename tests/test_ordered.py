"""Groups of any size give the same results as plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators.ordered import Groups, asof, ordered
from spindle.operators.selection import order_statistics


def skewed(spark, n=300, seed=1):
    """A third of the rows in one key, ties in time, a null key, null values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        rows.append((key, rng.randint(0, 40), i, None if rng.random() < 0.1 else rng.randint(0, 9)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_measure_finds_only_large_groups(spark):
    rows, df = skewed(spark)
    hot = Groups.measure(df, ["k"], limit=80).hot
    assert [r.k for r in hot.collect()] == ["hot"]
    assert Groups.measure(df, ["k"], limit=300).hot is None


def test_shifted_and_numbered(spark, group_rows):
    rows, df = skewed(spark)
    seq = ordered(df, ["k"], ["t", "id"]).numbered("n").shifted(
        {
            "lag2": lambda w: F.coalesce(F.lag("v", 2).over(w), F.lit(-1)),
            "next": lambda w: F.lead("id").over(w),
            "sum5": lambda w: F.sum("v").over(w.rowsBetween(-3, 1)),
        },
        before=3,
        after=1,
    )
    got = {r.id: r for r in seq.frame().collect()}
    assert len(got) == len(rows)
    for part in grouped(rows).values():
        for i, r in enumerate(part):
            g = got[r[2]]
            assert g.n == i + 1
            assert g.lag2 == (part[i - 2][3] if i >= 2 and part[i - 2][3] is not None else -1)
            assert g.next == (part[i + 1][2] if i + 1 < len(part) else None)
            near = [x[3] for x in part[max(0, i - 3) : i + 2] if x[3] is not None]
            assert g.sum5 == (sum(near) if near else None)


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_running(spark, group_rows, exclusive, backward):
    rows, df = skewed(spark)
    totals = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    got = {r.id: r for r in ordered(df, ["k"], ["t", "id"]).running(totals, exclusive, backward).frame().collect()}
    for part in grouped(rows).values():
        part = part[::-1] if backward else part
        for i, r in enumerate(part):
            seen = [x[3] for x in part[: i if exclusive else i + 1] if x[3] is not None]
            g = got[r[2]]
            want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
            assert (g.s, g.hi, g.lo, g.last) == want


def test_where_renumbers(spark, group_rows):
    rows, df = skewed(spark)
    kept = ordered(df, ["k"], ["t", "id"]).where(F.col("id") % 2 == 0).shifted({"p": lambda w: F.lag("id").over(w)}, before=1)
    got = {r.id: r.p for r in kept.frame().collect()}
    for part in grouped([r for r in rows if r[2] % 2 == 0]).values():
        assert [got[r[2]] for r in part] == [None, *[r[2] for r in part[:-1]]]


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, group_rows, ahead, strict):
    rng = random.Random(3)
    probes = [(rng.choice("xy"), rng.randint(0, 30), i) for i in range(60)]
    facts = list({(rng.choice("xy"), rng.randint(0, 30)) for _ in range(25)})
    got = asof(
        spark.createDataFrame(probes, "k string, at int, id int"),
        spark.createDataFrame([(k, a, a * 10) for k, a in facts], "k string, at int, fact int"),
        ["k"], "at", "fact", ahead=ahead, strict=strict,
    ).collect()
    assert len(got) == 60
    for r in got:
        mine = [a for k, a in facts if k == r.k]
        if ahead:
            fit = [a for a in mine if a > r["at"] or (a == r["at"] and not strict)]
            want = min(fit) * 10 if fit else None
        else:
            fit = [a for a in mine if a < r["at"] or (a == r["at"] and not strict)]
            want = max(fit) * 10 if fit else None
        assert r.fact == want


def test_order_statistics(spark, group_rows):
    rows, df = skewed(spark)
    probs = [0.0, 0.1, 0.5, 0.97, 0.999, 1.0]
    got = {r.k: r for r in order_statistics(df, ["k"], {"v": F.col("v"), "t": F.col("t")}, probs, mode=True).collect()}
    for key, part in grouped(rows).items():
        values = [r[3] for r in part if r[3] is not None]
        assert np.allclose(got[key].v_pct, [np.percentile(values, p * 100) for p in probs])
        assert np.allclose(got[key].t_pct, [np.percentile([r[1] for r in part], p * 100) for p in probs])
        counts = {v: values.count(v) for v in values}
        assert got[key].v_mode == min(v for v, c in counts.items() if c == max(counts.values()))


def test_no_keys(spark, group_rows):
    rows, df = skewed(spark)
    got = {r.id: r for r in ordered(df, [], ["t", "id"]).numbered("n").running({"s": ("sum", F.lit(1))}).frame().collect()}
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2]))):
        assert got[r[2]].n == i + 1 == got[r[2]].s
    wide = order_statistics(df, [], {"t": F.col("t")}, [0.25]).first()
    assert np.isclose(wide.t_pct[0], np.percentile([r[1] for r in rows], 25))


def test_empty_input(spark, group_rows):
    df = spark.createDataFrame([], "k string, t int, id int, v int")
    assert ordered(df, ["k"], ["t"]).numbered("n").running({"s": ("sum", F.col("v"))}).frame().count() == 0


def test_join_keeps_null_keys_and_all_rows(spark, group_rows):
    rows, df = skewed(spark)
    groups = Groups.measure(df, ["k"])
    assert groups.nulls and not Groups.measure(df.where("k is not null"), ["k"]).nulls
    sizes = df.groupBy("k").agg(F.count("id").alias("n"))
    got = groups.join(df, sizes).collect()
    assert len(got) == len(rows)
    assert all(r.n == len(grouped(rows)[r.k]) for r in got)


def test_tables_past_the_broadcast_size_are_shuffled(spark, monkeypatch):
    from spindle.operators import ordered as module

    rows, df = skewed(spark)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    groups = Groups.measure(df, ["k"], limit=20)
    assert groups.hot is not None and not groups.few
    totals = df.groupBy("k").agg(F.count("id").alias("n"))
    joined = groups.join(df, totals)
    sizes = {k: len(v) for k, v in grouped(rows).items()}
    assert sorted((r.id, r.n) for r in joined.collect()) == sorted((r[2], sizes[r[0]]) for r in rows)
    assert "BroadcastHint" not in joined._jdf.queryExecution().logical().toString() and "strategy=broadcast" not in joined._jdf.queryExecution().logical().toString()
    numbered = ordered(df, ["k"], ["t", "id"], groups).numbered("n").frame()
    want = sorted((r[2], n) for part in grouped(rows).values() for n, r in enumerate(part, start=1))
    assert sorted((r.id, r.n) for r in numbered.collect()) == want
