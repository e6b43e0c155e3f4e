"""Empirical distributions, densities and knees of a column, per group.

All of them start from the counts of equal values, which merge across tasks; ranks are running sums over those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.scalars import finite, percent_text, ratio, round_half_even
from spindle.operators.ordered import Groups, fits, key_join, ordered
from spindle.operators.selection import order_statistics
from spindle.session import stable

KNEE_GRID = 10_000  # points on [0, 1] the tangent knee is searched on
#: Width of a segment of values in units of a kernel's decay: what is farther away counts for e**-300 at most.
SEGMENT = 300.0
KNEE_PERCENT = 97  # the longest 3% are left out


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, groups: Groups | None = None) -> DataFrame:
    """Distinct values ``x`` per group with their count ``n``, rank ``upto`` and the group's ``total``."""
    counted = df.select(*keys, value.cast("double").alias("x")).where(F.col("x").isNotNull())
    counts = counted.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    groups = groups or Groups.measure(df, keys)  # there are no more distinct values than rows
    ranked = ordered(counts, keys, ["x"], groups).running({"upto": ("sum", F.col("n"))}).frame()
    return groups.join(ranked, counts.groupBy(*keys).agg(F.sum("n").alias("total")))


def ecdf(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Distinct values and the share of rows up to each."""
    return value_counts(df, keys, value).select(*keys, "x", (F.col("upto") / F.col("total")).alias("y"))


def rank_ecdf(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Distinct values with their number of rows and average rank over the row count."""
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    return value_counts(df, keys, value).select(*keys, "x", "n", (rank / F.col("total")).alias("y"))


def sampled_cdf(
    df: DataFrame, keys: Sequence[str], value: Column, low: float = 0.0, high: float = 1.0, precision: float = 0.0001
) -> DataFrame:
    """First value of every probability step of width ``precision`` in ``[low, high]``, and the last value."""
    inside = ecdf(df, keys, value).where((F.col("y") >= low) & (F.col("y") <= high))
    step = F.floor((F.col("y") - low) / precision)
    firsts = inside.groupBy(*keys, step.alias("_step")).agg(F.min(F.struct("x", "y")).alias("_p"))
    points = firsts.select(*keys, "_p.x", "_p.y")
    ends = inside.groupBy(*keys).agg(F.max(F.struct("x", "y")).alias("_p")).select(*keys, "_p.x", "_p.y")
    return points.union(ends).distinct()


def densities(df: DataFrame, keys: Sequence[str], value: Column, grid: tuple[float, float, float] | None = None) -> DataFrame:
    """Kernel density at every distinct value (``point`` null), and on a grid (low, high, step) if given, with its integral.

    Silverman's kernel with Scott's bandwidth, 1.06 * std * n**-0.2. The kernel is a damped sine, so the sum over all values
    below a point follows from that at the point before by one complex factor. Seen from the start of a segment of values
    that is a running sum, and so is the sum over the values above; a segment is so wide that only the next ones still
    count. No value meets another one: the work is that of sorting the distinct values. Returns keys, x, n, point, pdf, cdf;
    groups whose values are all equal have none.
    """
    rows = df.select(*keys, value.cast("double").alias("x")).where(F.col("x").isNotNull())
    spread = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        (1.06 * F.stddev_samp("x") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("_h"),
        F.min("x").alias("_low"),
    )
    spread = stable(spread.where(F.col("_h") > 0))
    counts = rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    groups = Groups.measure(df, keys)
    points = groups.join(counts.withColumn("point", F.lit(None).cast("long")), spread)
    if grid:
        low, high, step = grid
        places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(round((high - low) / step)).cast("long")))
        on_grid = spread.select("*", places.alias("point")).withColumns({"x": F.col("point") * F.lit(step) + F.lit(low), "n": F.lit(0).cast("long")})
        points = points.unionByName(on_grid)
    far = (F.col("x") - F.col("_low")) / F.col("_h") / F.lit(math.sqrt(2.0))
    points = points.withColumn("_seg", F.floor(far / SEGMENT)).withColumn("_t", far - F.col("_seg") * SEGMENT)
    points = stable(points.withColumn("_grid", F.col("point").isNotNull()))  # after the value it falls on
    by, t, n = [*keys, "_seg"], F.col("_t"), F.col("n")
    ahead = {"_a": n * F.exp(t) * F.cos(t), "_b": n * F.exp(t) * F.sin(t), "_upto": n}
    behind = {"_c": n * F.exp(-t) * F.cos(t), "_d": n * F.exp(-t) * F.sin(t)}
    lines = ordered(points, by, ["x", "_grid"], Groups.measure(points, by, groups.limit, staged=True))
    lines = lines.running({c: ("sum", v) for c, v in ahead.items()})
    lines = lines.running({c: ("sum", v) for c, v in behind.items()}, exclusive=True, backward=True).frame()
    # what the segments on both sides add, seen from the segment's start
    sums = points.groupBy(*by).agg(*[F.sum(v).alias(c) for c, v in (ahead | behind).items()])
    w = Window.partitionBy(*keys).orderBy("_seg")
    before, after = F.lag("_seg").over(w) == F.col("_seg") - 1, F.lead("_seg").over(w) == F.col("_seg") + 1
    beside = [F.when(before, F.lag(c).over(w)).alias(f"{c}_p") for c in ("_a", "_b")] + [F.when(after, F.lead(c).over(w)).alias(f"{c}_n") for c in ("_c", "_d")]
    earlier = F.sum("_upto").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier")
    sums = stable(sums.select(*by, *beside, earlier))
    lines = key_join(lines, sums, by, small=fits(sums)).fillna(0.0, subset=["_c", "_d", "_a_p", "_b_p", "_c_n", "_d_n"])
    real, imaginary = [], []
    for x, y, angle, reach in (("_a", "_b", t, -t), ("_a_p", "_b_p", t + SEGMENT, -t - SEGMENT)):
        real.append(F.exp(reach) * (F.col(x) * F.cos(angle) + F.col(y) * F.sin(angle)))
        imaginary.append(F.exp(reach) * (F.col(x) * F.sin(angle) - F.col(y) * F.cos(angle)))
    for x, y, angle in (("_c", "_d", t), ("_c_n", "_d_n", t - SEGMENT)):
        real.append(F.exp(angle) * (F.col(x) * F.cos(angle) + F.col(y) * F.sin(angle)))
        imaginary.append(F.exp(angle) * (F.col(y) * F.cos(angle) - F.col(x) * F.sin(angle)))
    pdf = (sum(real[1:], real[0]) + sum(imaginary[1:], imaginary[0])) * F.lit(math.sqrt(2.0) / 4) / F.col("_total") / F.col("_h")
    below = F.col("_upto") + F.coalesce("_earlier", F.lit(0))
    cdf = (below - 0.5 * (real[0] + real[1]) + 0.5 * (real[2] + real[3])) / F.col("_total")
    return lines.select(*keys, "x", "n", "point", pdf.alias("pdf"), cdf.alias("cdf"))


def density(
    df: DataFrame, keys: Sequence[str], value: Column, low: float = 0.0, high: float = 20.0, step: float = 0.1
) -> DataFrame:
    """Kernel density on a grid; see ``densities``."""
    found = densities(df, keys, value, (low, high, step)).where(F.col("point").isNotNull())
    return found.select(*keys, "point", F.col("x").alias("grid"), "pdf")


def density_cdf(pdf: DataFrame, keys: Sequence[str], step: float = 0.1) -> DataFrame:
    """Running integral of a gridded density."""
    rows = ordered(pdf, keys, ["point"]).running({"_sum": ("sum", F.col("pdf"))}).frame()
    return rows.select(*keys, "point", "grid", (F.col("_sum") * F.lit(step)).alias("cdf"))


def series_variants(df: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """A series as is, mean-normalised, and both as ratio to the previous value (0 where undefined)."""
    groups = Groups.measure(df, keys)
    joined = groups.join(df, df.groupBy(*keys).agg(F.avg(value).alias("_mean")))
    joined = joined.withColumn("norm", ratio(F.col(value), F.col("_mean"))).drop("_mean")
    made = {
        "diff": lambda w: ratio(F.col(value), F.lag(value).over(w)),
        "diff_norm": lambda w: ratio(F.col("norm"), F.lag("norm").over(w)),
    }
    return ordered(joined, keys, [order], groups).shifted(made, before=1).frame().withColumnRenamed(value, "real")


VARIANTS = ("real", "norm", "diff", "diff_norm")


def stat_series(df: DataFrame, keys: Sequence[str], order: str, metrics: Sequence[str], digits: int = 9) -> DataFrame:
    """Every metric of the series as is, mean-normalised and as ratio to the previous value, each as four statistics.

    Rows (keys, metric, variant, stat, x, y): ``raw`` has the values y in the order x; ``pdf``, ``cdf_from_pdf`` (the density's
    integral) and ``cdf`` (the share of rows up to x) have one row per distinct value x. A variant that never changes has
    no density. Values are rounded to ``digits``, so that equal ratios are equal.
    """
    long = df.select(*keys, order, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*keys, order], list(metrics), "metric", "value")
    by = [*keys, "metric", "variant"]
    variants = series_variants(long.where("value IS NOT NULL"), [*keys, "metric"], order)
    variants = stable(variants.unpivot([*keys, "metric", order], list(VARIANTS), "variant", "y").withColumn("y", F.round("y", digits)))
    smooth = stable(densities(variants, by, F.col("y")))
    stats = {
        "raw": variants.select(*by, F.col(order).cast("double").alias("x"), "y"),
        "pdf": smooth.select(*by, "x", F.col("pdf").alias("y")),
        "cdf_from_pdf": smooth.select(*by, "x", F.col("cdf").alias("y")),
        "cdf": ecdf(variants, by, F.col("y")),
    }
    parts = [part.withColumn("stat", F.lit(name)) for name, part in stats.items()]
    return reduce(DataFrame.unionByName, parts)


def tangent_knee(
    df: DataFrame, keys: Sequence[str], metrics: dict[str, Column], groups: Groups | None = None, cuts: DataFrame | None = None
) -> DataFrame:
    """Knee per metric: where the distribution function is furthest above the diagonal.

    Values up to the 97th percentile (``cuts``: ``<metric>_cut``, if known already) are scaled by their maximum. On
    the grid only the first point at or after a value can be furthest, so values are counted per grid point: at most
    10,000 rows per group and metric remain to be ordered. Returns ``<metric>_knee`` (whole number) and
    ``<metric>_knee_percent``.
    """
    groups = groups or Groups.measure(df, keys)
    values = {n: finite(c) for n, c in metrics.items()}
    if cuts is None:
        cuts = order_statistics(df, keys, values, [KNEE_PERCENT / 100], groups)
        cuts = cuts.select(*keys, *[F.col(f"{n}_pct")[0].alias(f"{n}_cut") for n in metrics])
    pairs = [F.struct(F.lit(n).alias("metric"), c.alias("_v")) for n, c in values.items()]
    counts = df.select(*keys, F.inline(F.array(*pairs))).where(F.col("_v").isNotNull())
    by = [*keys, "metric"]
    counts = counts.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    kept = groups.join(counts, cuts).where(F.col("_v") <= _of_metric(metrics, "cut")).drop(*[f"{n}_cut" for n in metrics])
    here = {n: F.col("metric") == n for n in metrics}
    tops = [F.max(F.when(t, F.col("_v"))).alias(f"{n}_top") for n, t in here.items()]
    tops += [F.sum(F.when(t, F.col("_n"))).alias(f"{n}_total") for n, t in here.items()]
    topped = groups.join(kept, kept.groupBy(*keys).agg(*tops))
    topped = topped.select(*by, "_v", "_n", _of_metric(metrics, "top").alias("_top"), _of_metric(metrics, "total").alias("_total"))
    last = KNEE_GRID - 1
    point = F.when(F.col("_top") > 0, F.ceil(F.col("_v") / F.col("_top") * last)).otherwise(F.lit(0)).cast("long")
    points = topped.groupBy(*by, "_top", "_total", point.alias("_g")).agg(F.sum("_n").alias("_n"))
    if keys:
        points = points.repartition(*keys)  # serves the running sum and both aggregates below
    w = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    y = F.sum("_n").over(w) / F.col("_total")
    curve = points.withColumn("_y", y).withColumn("_t", F.col("_y") - F.col("_g") / F.lit(float(last)))
    # furthest point, the smallest one on a tie; the origin if none lies above the diagonal
    best = curve.groupBy(*by, "_top").agg(F.max(F.struct("_t", (-F.col("_g")).alias("g"), "_y")).alias("_b"))
    above = F.col("_b._t") > 0
    knee = best.select(
        *by,
        F.when(above, F.floor(-F.col("_b.g") / F.lit(float(last)) * F.col("_top"))).otherwise(0).cast("double").alias("knee"),
        F.when(above, F.col("_b._y") * (KNEE_PERCENT / 100) * 100).otherwise(0.0).alias("percent"),
    )
    wide = [F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"{n}_{a}") for n in metrics for c, a in (("knee", "knee"), ("percent", "knee_percent"))]
    return knee.groupBy(*keys).agg(*wide)


def _of_metric(metrics: dict[str, Column], field: str) -> Column:
    """The row's own metric's ``<metric>_<field>``."""
    return F.coalesce(*[F.when(F.col("metric") == n, F.col(f"{n}_{field}")) for n in metrics])


def percentile_curve(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Percentiles 1 to 100 of the finite values (2 decimals) as rows ``p``, ``x``, with five times the median as ``x_max``."""
    probs = [0.5, *[p / 100 for p in range(1, 101)]]
    stats = order_statistics(df, keys, {"v": finite(value)}, probs)
    curve = stats.select(*keys, (F.col("v_pct")[0] * 5).alias("x_max"), F.posexplode(F.slice("v_pct", 2, 100)).alias("_i", "_x"))
    return curve.select(*keys, "x_max", (F.col("_i") + 1).alias("p"), round_half_even(F.col("_x"), 2).alias("x"))


def area_knee(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Percentile where the area below the curve to the left balances the area to the right of it above."""
    curve = percentile_curve(df, keys, value).withColumn("x", F.least("x", "x_max"))
    y = F.col("p") * F.col("x_max") / 100
    w = Window.partitionBy(*keys).orderBy("p")  # 100 rows per group
    whole = Window.partitionBy(*keys)
    curve = curve.withColumns({"_y": y, "_top": F.max("x").over(whole), "_px": F.lag("x").over(w), "_py": F.lag(y).over(w)})
    # the segment from the previous percentile to this one
    down = (F.col("_py") + F.col("_y")) * F.abs(F.col("x") - F.col("_px")) / 2
    right = ((F.col("_top") - F.col("x")) + (F.col("_top") - F.col("_px"))) * F.abs(F.col("_y") - F.col("_py")) / 2
    curve = curve.withColumns({"_down": F.coalesce(down, F.lit(0.0)), "_right": F.coalesce(right, F.lit(0.0))})
    # for the p-th percentile: segments up to the one after it go down, segments from there on go right
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    curve = curve.withColumns(
        {
            "_area_down": F.floor(F.sum("_down").over(w.rowsBetween(first, 1))),
            "_area_right": F.floor(F.sum("_right").over(w.rowsBetween(1, last))),
        }
    )
    diff = F.abs(F.col("_area_down") - F.col("_area_right"))
    best = curve.where(F.col("p").between(2, 99)).groupBy(*keys).agg(F.min(F.struct(diff.alias("d"), "p", "x")).alias("_b"))
    return best.select(*keys, F.col("_b.x").alias("knee"), F.col("_b.p").cast("long").alias("knee_percent"))


def area_left_of(df: DataFrame, keys: Sequence[str], value: Column, percent: int) -> DataFrame:
    """Area under the percentile curve up to a percentile (unit steps, trapezoids)."""
    curve = percentile_curve(df, keys, value)
    w = Window.partitionBy(*keys).orderBy("p")  # 100 rows per group
    steps = curve.withColumn("_a", (F.col("x") + F.lag("x").over(w)) / 2).where(F.col("p") <= percent + 1)
    return steps.groupBy(*keys).agg(F.sum("_a").alias("area"))


def _curve_area(counts: DataFrame, keys: Sequence[str], groups: Groups) -> DataFrame:
    """Trapezoid area under (value, rank - 1 over total) below ``limit``; with the last point on it."""
    kept = counts.where(F.col("x") < F.col("limit"))
    rows = ordered(kept, keys, ["x"], groups).shifted({"_px": lambda w: F.lag("x").over(w), "_pu": lambda w: F.lag("upto").over(w)}, before=1).frame()
    # equal values have no width; the step to the next value rises by one row
    area = (F.col("x") - F.col("_px")) * (2 * F.col("_pu") - 1) / (2 * F.col("total"))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias("area"),
        F.max("x").alias("end_x"),
        F.max((F.col("upto") - 1) / F.col("total")).alias("end_y"),
    )


def cdf_gain(df: DataFrame, keys: Sequence[str], value: Column, accepted: Column) -> DataFrame:
    """Gain of the accepted rows' distribution area over that of all rows, as percent text; ``0%`` below 100 rows."""
    groups = Groups.measure(df, keys)
    rows = df.withColumn("_v", value.cast("double"))
    stats = order_statistics(rows, keys, {"v": F.col("_v")}, [0.7], groups)
    limits = stats.select(*keys, F.greatest(F.col("v_pct")[0] * 3, F.lit(1000.0)).alias("limit"))
    raw = _curve_area(groups.join(value_counts(rows, keys, F.col("_v"), groups), limits), keys, groups)
    best = _curve_area(groups.join(value_counts(rows.where(accepted), keys, F.col("_v"), groups), limits), keys, groups)
    best = best.select(*keys, F.col("area").alias("best"), F.col("end_x").alias("best_x"), F.col("end_y").alias("best_y"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    joined = key_join(key_join(raw, best, keys, "left"), sizes, keys)
    pad = F.when(F.col("best_x") < F.col("end_x"), (F.col("end_x") - F.col("best_x")) * (F.col("best_y") + 1) / 2).otherwise(0.0)
    gain = percent_text(F.col("best") + pad - F.col("area"), F.col("area"))
    return joined.select(*keys, F.when(F.col("_n") < 100, F.lit("0%")).otherwise(gain).alias("cdf_gain"))


def accepted_cdf(df: DataFrame, keys: Sequence[str], value: Column, accepted: Column) -> DataFrame:
    """Distribution of all rows and of the accepted ones, with the share of slow rows and the plotting limit."""
    groups = Groups.measure(df, keys)
    rows = df.select(*keys, value.cast("double").alias("_v"), accepted.alias("_ok"))
    stats = order_statistics(rows, keys, {"v": F.col("_v")}, [0.7], groups)
    limits = stats.select(*keys, F.greatest(F.col("v_pct")[0] * 3, F.lit(1000.0)).alias("x_limit"))
    sizes = rows.groupBy(*keys).agg(F.floor(F.count_if(~F.col("_ok")) * 100 / F.count(F.lit(1))).alias("percent_slow"))
    y = ((F.col("upto") - 1) / F.col("total")).alias("y")
    curves = [
        value_counts(part, keys, F.col("_v"), groups).select(*keys, F.lit(kind).alias("kind"), "x", y)
        for kind, part in (("raw", rows), ("accepted", rows.where(F.col("_ok"))))
    ]
    return groups.join(curves[0].unionByName(curves[1]), key_join(limits, sizes, keys))


def describe(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles."""
    rows = df.withColumn("_v", value.cast("double"))
    moments = rows.groupBy(*keys).agg(
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    quartiles = order_statistics(rows, keys, {"v": F.col("_v")}, [0.25, 0.5, 0.75])
    joined = key_join(moments, quartiles, keys) if keys else moments.join(F.broadcast(quartiles))
    names = ("p25", "p50", "p75")
    return joined.select(*moments.columns, *[F.col("v_pct")[i].alias(n) for i, n in enumerate(names)])
