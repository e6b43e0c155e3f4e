import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import distribution as ds
from spindle.session import GROUP_ROWS_CONF


def pairs(x, at):
    """Density and its integral by comparing every pair."""
    h = 1.06 * np.std(x, ddof=1) * len(x) ** -0.2
    u = (at[:, None] - x[None, :]) / h / math.sqrt(2)
    d = np.abs(u)
    pdf = (0.5 * np.exp(-d) * np.sin(d + math.pi / 4)).mean(axis=1) / h
    tail = 0.5 * np.exp(-d) * np.cos(d)
    return pdf, np.where(u >= 0, 1 - tail, tail).mean(axis=1)


def samples():
    rng = random.Random(9)
    wide = [rng.gauss(0, 1) for _ in range(1500)] + [rng.gauss(0, 1) * 10 ** rng.randrange(6) for _ in range(500)]  # many segments, empty ones among them
    return {"smooth": [rng.gauss(5, 2) for _ in range(2000)], "tied": [float(rng.randrange(7)) for _ in range(900)], "wide": wide, "flat": [2.0] * 9, "one": [1.0]}


@pytest.mark.parametrize("limit", [None, 60])
def test_densities_against_all_pairs(spark, limit):
    if limit:
        spark.conf.set(GROUP_ROWS_CONF, str(limit))
    try:
        made = samples()
        df = spark.createDataFrame([(k, v) for k, xs in made.items() for v in xs] + [("smooth", None)], "k string, v double").repartition(4)
        got = ds.densities(df, ["k"], F.col("v"), (0.0, 20.0, 0.1)).collect()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert {r.k for r in got} == {"smooth", "tied", "wide"}
    for key in ("smooth", "tied", "wide"):
        x = np.array(made[key])
        own = sorted((r.x, r.pdf, r.cdf, r.n) for r in got if r.k == key and r.point is None)
        at = np.array([r[0] for r in own])
        assert (at == np.unique(x)).all() and sum(r[3] for r in own) == len(x)
        pdf, cdf = pairs(x, at)
        assert np.allclose([r[1] for r in own], pdf, rtol=1e-8, atol=1e-12) and np.allclose([r[2] for r in own], cdf, atol=1e-10)
        grid = {r.point: (r.pdf, r.cdf) for r in got if r.k == key and r.point is not None}
        pdf, cdf = pairs(x, np.arange(201) * 0.1)
        assert sorted(grid) == list(range(201))
        assert np.allclose([grid[i][0] for i in range(201)], pdf, rtol=1e-8, atol=1e-12) and np.allclose([grid[i][1] for i in range(201)], cdf, atol=1e-10)


def test_densities_without_keys_and_empty(spark):
    df = spark.createDataFrame([(float(i % 11),) for i in range(50)], "v double")
    got = {r.x: r.pdf for r in ds.densities(df, [], F.col("v")).collect()}
    x = np.array([float(i % 11) for i in range(50)])
    assert np.allclose([got[v] for v in sorted(got)], pairs(x, np.arange(11.0))[0])
    assert ds.densities(df.where("false"), [], F.col("v"), (0.0, 1.0, 0.5)).count() == 0


def test_stat_series(spark):
    rows = [("d", i, float(i * i % 7), 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "device string, idx int, a double, flat double")
    got = ds.stat_series(df, ["device"], "idx", ["a", "flat"]).collect()
    kinds = {(r.metric, r.variant, r.stat) for r in got}
    assert {k for k in kinds if k[0] == "a"} == {("a", v, s) for v in ds.VARIANTS for s in ("raw", "pdf", "cdf", "cdf_from_pdf")}
    assert {(v, s) for m, v, s in kinds if m == "flat" and s == "pdf"} == {("diff", "pdf"), ("diff_norm", "pdf")}
    raw = sorted((r.x, r.y) for r in got if (r.metric, r.variant, r.stat) == ("a", "real", "raw"))
    assert raw == [(float(i), float(i * i % 7)) for i in range(40)]
    cdf = sorted((r.x, r.y) for r in got if (r.metric, r.variant, r.stat) == ("a", "real", "cdf"))
    x = np.array([r[1] for r in raw])
    assert cdf == [(v, np.mean(x <= v)) for v in np.unique(x)]
