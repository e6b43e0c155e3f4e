"""Scores, rules, samples, groups and policies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import evaluate as ev
from spindle.operators import joins, ml, policy, sampling
from spindle.operators.features import FEATURES


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(21)
    rows = []
    for i in range(300):
        p = rng.random()
        rows.append((f"m{i % 3}", i % 5, i, int(rng.random() < 0.4), int(p > 0.5), p, rng.choice([0, 1])))
    schema = "model string, window_id int, row_id int, label int, prediction int, probability double, io_type int"
    return rows, spark.createDataFrame(rows, schema)


def test_scores(scored):
    rows, df = scored
    for r in ev.evaluate(df, ["window_id"]).collect():
        part = [x for x in rows if x[1] == r.window_id]
        y, s = np.array([x[3] for x in part]), np.array([x[4] for x in part])
        tp, tn, fp, fn = ((y & s).sum(), ((1 - y) & (1 - s)).sum(), ((1 - y) & s).sum(), (y & (1 - s)).sum())
        assert (r.tp, r.tn, r.fp, r.fn) == (tp, tn, fp, fn)
        assert np.isclose(r.accuracy, (tp + tn) / len(part))
        assert np.isclose(r.auc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 3))
        base, prec, rec = (tp + fn) / len(part), tp / (tp + fp), tp / (tp + fn)
        assert np.isclose(r.pr_auc, round(rec * prec + (1 - rec) * base, 3))
        p = np.clip([x[5] for x in part], ev.EPSILON, 1 - ev.EPSILON)
        assert np.isclose(r.entropy, np.mean(-p * np.log2(p) - (1 - p) * np.log2(1 - p)))


def test_one_class_and_certain_rows(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "label int, prediction int, probability double")
    r = ev.evaluate(df, []).first()
    assert (r.auc, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert abs(r.entropy) < 1e-12


def test_cells_sum_to_rows(scored):
    _, df = scored
    for r in ev.confidence_cases(df, ["model", "window_id"]).collect():
        assert r.best_case + r.worst_case + r.lucky_case + r.clueless_case == r.num_io
        for c in ev.CELLS:
            assert r[f"{c}_reject"] + r[f"{c}_accept"] == r[f"{c}_case"]


def test_choose_group(spark, group_rows):
    rng = random.Random(22)
    groups = []
    for i in range(9):
        low = rng.randint(0, 60)
        groups.append((f"g{i}", float(low + rng.randint(0, 20)), float(low), float(low + rng.randint(5, 40))))
    values = [rng.randint(0, 130) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, size int")
    got = joins.choose_group(df, spark.createDataFrame(groups, "group string, avg double, lower double, upper double")).collect()
    assert len(got) == 200
    for r in got:
        fit = sorted((abs(a - values[r.id]), g) for g, a, lo, hi in groups if lo <= values[r.id] <= hi)
        assert r.in_interval == bool(fit)
        assert r.group == (fit[0][1] if fit else f"g{values[r.id] % 9}")


def test_choose_group_keeps_rows_without_a_value(spark, group_rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 500)], "id int, size int")
    groups = spark.createDataFrame([("a", 5.0, 0.0, 9.0), ("b", 20.0, 10.0, 30.0)], "group string, avg double, lower double, upper double")
    got = sorted((r.id, r.group, r.in_interval) for r in joins.choose_group(df, groups).collect())
    assert got == [(1, "a", True), (2, "a", False), (3, "a", False), (4, "a", False)]


def test_samples_repeat_and_hold_their_sizes(spark, group_rows):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("io_type"), F.col("id").cast("double").alias("ts_record"))
    one = sampling.thin(df, 0.25, ["id"])
    two = sampling.thin(df.repartition(7), 0.25, ["id"])
    assert one.exceptAll(two).count() == 0 and 600 < one.count() < 900
    assert 7200 < sampling.thicken(df, 2.5, ["id"]).count() < 7800
    picked = sampling.pick(df, ["io_type"], ["id"], 10).groupBy("io_type").agg(F.count("id").alias("n")).collect()
    assert [r.n for r in picked] == [10, 10]


def test_schedules(spark, group_rows):
    rows = [("size", float(m), f"w{m}_{i}", 1.0) for m in (1, 2, 3) for i in range(14)]
    df = spark.createDataFrame(rows, "metric string, multiplier double, name string, value double")
    got = sampling.drift_schedules(df, per_step=12).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.type, []).append((r.position, r.multiplier))
    sudden = [m for _, m in sorted(kinds["sudden"])]
    assert sudden == [1.0] * 12 + [2.0] * 12 + [3.0] * 12
    gradual = [m for _, m in sorted(kinds["gradual"])]
    mix = lambda a, b: [b, a, a, a, b, b, a, a, b, b, b, a]
    assert gradual == [1.0] * 8 + mix(1.0, 2.0) + [2.0] * 8 + mix(2.0, 3.0) + [3.0] * 8
    assert [m for _, m in sorted(kinds["incremental"])] == [1.0] * 12 + [2.0] * 5 + [3.0] * 12
    assert [m for _, m in sorted(kinds["recurring"])] == [1.0] * 6 + [3.0] * 6 + [1.0] * 6 + [3.0] * 6


def test_top_up(spark):
    everything = spark.createDataFrame([(0, i, int(i < 10)) for i in range(100)], "w int, id int, reject int")
    none = everything.where(F.col("reject") == 0)
    got = sampling.top_up_missing_class(none, everything, ["w"], ["id"])
    assert got.where(F.col("reject") == 1).count() == 2  # a quarter of 90 is more than 10, so a quarter of 10
    both = everything.where(F.col("id") < 20)
    assert sampling.top_up_missing_class(both, everything, ["w"], ["id"]).count() == 20


def test_policies_run(spark):
    rng = random.Random(23)
    rows = []
    for i in range(600):
        w = i // 200
        x = [rng.random() for _ in FEATURES]
        rows.append((w, i, *x, int((x[0] > 0.5) != (w > 0 and rng.random() < 0.6))))
    schema = "window_id int, row_id int, " + ", ".join(f"{f} double" for f in FEATURES) + ", reject int"
    df = ml.standardise(ml.assemble(spark.createDataFrame(rows, schema)))
    for name in ("initial_only", "retrain_all", "ensemble"):
        got = policy.run_policy(df, name, min_rows=50).orderBy("window_id").collect()
        assert [r.window_id for r in got] == [1, 2]
        assert all(r.num_io == 200 for r in got)
        assert got[0].retrained == (name != "initial_only")
