import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import selection
from spindle.operators.selection import order_statistics, rank_all, select_ranks

PROBS = [0.5, 0.1, 0.25, 0.999, 0.9999, 1.0, 0.0, 0.75]


def values(spark, parts):
    rng = random.Random(6)
    rows = [("smooth", rng.gauss(0, 1)) for _ in range(20_000)] + [("tied", float(rng.choice([1, 2, 2, 3, 500]))) for _ in range(9_000)]
    rows += [("flat", 7.0)] * 6_000 + [(None, x) for x in (3.0, -0.0, 0.0, 1e300, -1e300)] * 1500 + [("one", 5.0)]
    rows += [("long", 2.0 ** (i % 30) + rng.random()) for i in range(5_000)] + [("nan", x) for x in (float("nan"), 1.0, 2.0)] * 500
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(parts)


def grouped(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return out


def check(got, rows):
    for key, own in grouped(rows).items():
        if key == "nan":
            assert np.isclose(got[key].pct[0], 2.0) and np.isnan(got[key].pct[5])
            continue
        assert np.allclose(got[key].pct, [np.percentile(own, p * 100) for p in PROBS], rtol=1e-12), key


@pytest.mark.parametrize("limit", [50, 1000, 10**6])
def test_select_ranks(spark, limit):
    rows, df = values(spark, 5)
    got = {r.k: r for r in select_ranks(df, ["k"], PROBS, limit, mode=True).collect()}
    check(got, rows)
    for key, own in grouped(rows).items():
        counts = {}
        for v in own:
            counts[v + 0.0] = counts.get(v + 0.0, 0) + 1
        if key != "nan":
            assert got[key].mode == min(v for v, c in counts.items() if c == max(counts.values()))


def test_brackets_that_miss_send_a_group_through_all_values(spark, monkeypatch):
    rows, df = values(spark, 3)
    monkeypatch.setattr(selection, "ACCURACY", 10**9)  # brackets of no width
    calls = []
    whole = selection.rank_all
    monkeypatch.setattr(selection, "rank_all", lambda *a: calls.append(1) or whole(*a))
    check({r.k: r for r in select_ranks(df, ["k"], PROBS, 1000).collect()}, rows)
    assert calls


def test_all_values_agree_with_selection(spark):
    rows, df = values(spark, 4)
    check({r.k: r for r in rank_all(df.select("k", (F.col("v") + 0).alias("v")), ["k"], PROBS, 100).collect()}, rows)


def test_raw_values_are_not_shuffled(spark):
    """The counts that are shuffled and sorted are a small part of the distinct values."""
    rows, df = values(spark, 5)
    smooth = df.where("k = 'smooth'")
    brackets = selection._brackets(smooth, ["k"], sorted(PROBS))
    counts = selection._counted(smooth, ["k"], brackets, sorted(PROBS))
    assert counts.agg(F.sum("n")).first()[0] == 20_000 and counts.count() < 20_000 * 0.03


def test_empty_and_null_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert select_ranks(df.where("false"), ["k"], PROBS, 10, mode=True).count() == 0
    got = {r.k: r for r in order_statistics(df, ["k"], {"v": F.col("v")}, [0.5], mode=True).collect()}
    assert got["a"].v_pct is None and got["b"].v_pct == [1.0] and got["b"].v_mode == 1.0
