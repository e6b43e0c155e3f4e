"""The fixed set of statistics kept per metric."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.ordered import Groups, key_join
from spindle.operators.selection import select_ranks

# fixed values: percentile names and their probabilities
PERCENTILES = {
    "p10": 0.1, "p20": 0.2, "p25": 0.25, "p30": 0.3, "p40": 0.4, "p50": 0.5, "p60": 0.6, "p70": 0.7, "p75": 0.75,
    "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p9999": 0.9999, "p100": 1.0,
}
# fixed values: the further mid points of the finer percentile list
FINER_PERCENTILES = {f"p{p}": p / 100 for p in (15, 35, 45, 55, 65, 85)}
MOMENTS = ("count", "sum", "avg", "min", "max", "mode", "median", "variance", "std")
STATISTICS = (*MOMENTS, *PERCENTILES)


#: What a statistic of whole rows is: an aggregate function and the value it takes of each row.
Extra = tuple[Callable[[Column], Column], Column]
_ROW = -1


def _moments() -> list[Column]:
    v = F.col("v")
    named = {"count": F.count(v), "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "variance": F.var_pop(v), "std": F.stddev_pop(v)}
    return [c.alias(n) for n, c in named.items()]


def _long(df: DataFrame, keys: Sequence[str], metrics: dict[str, Column], extra: dict[str, Extra]) -> DataFrame:
    """A row per metric that has a value, and one (``_ROW``) for the row itself: a few expressions then do for all metrics."""
    pairs = [F.struct(F.lit(i).alias("_m"), c.cast("double").alias("v")) for i, c in enumerate(metrics.values())]
    if extra:
        pairs.append(F.struct(F.lit(_ROW).alias("_m"), F.lit(None).cast("double").alias("v")))
    rows = df.select(*keys, *[value.alias(f"_e_{n}") for n, (_, value) in extra.items()], F.inline(F.array(*pairs)))
    return rows.where(F.col("v").isNotNull() | (F.col("_m") == _ROW))


def statistics(
    df: DataFrame,
    keys: Sequence[str],
    metrics: dict[str, Column],
    extra: dict[str, Extra] | None = None,
    groups: Groups | None = None,
    percentiles: dict[str, float] | None = None,
) -> DataFrame:
    """One row per group with ``<metric>_<statistic>`` columns and the ``extra`` aggregates.

    Count, sum, extremes and variance merge across tasks, so they need no care. Percentiles and mode hold the
    distinct values of a group in memory, so groups over the limit go through selection by sketches instead.
    """
    percentiles, extra = percentiles or PERCENTILES, extra or {}
    probs = list(percentiles.values())
    groups = groups or Groups.measure(df, keys)
    extras = [how(F.when(F.col("_m") == _ROW, F.col(f"_e_{n}"))).alias(f"_e_{n}") for n, (how, _) in extra.items()]
    by = [*keys, "_m"]
    parts = []
    cold, hot = groups.cold_part(df), groups.hot_part(df)
    if cold is not None:
        held = [F.percentile("v", probs).alias("pct"), F.mode("v", True).alias("mode")]
        parts.append(_long(cold, keys, metrics, extra).groupBy(*by).agg(*extras, *_moments(), *held))
    if hot is not None:
        long = _long(hot, keys, metrics, extra)
        picked = select_ranks(long.where(F.col("_m") != _ROW).select(*by, "v"), by, probs, groups.limit, mode=True)
        parts.append(key_join(long.groupBy(*by).agg(*extras, *_moments()), picked, by, "left"))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fields = F.struct("count", "sum", "avg", "min", "max", "mode", "variance", "std", "pct")
    none = {n: F.lit(0 if how is F.count else None) for n, (how, _) in extra.items()}  # of an empty table without keys
    wide = [F.coalesce(F.max(F.when(F.col("_m") == _ROW, F.col(f"_e_{n}"))), none[n]).alias(n) for n in extra]
    wide += [F.max(F.when(F.col("_m") == i, fields)).alias(f"_m{i}") for i in range(len(metrics))]
    picked = [f"`{c}`" for c in (*keys, *extra)]
    for i, name in enumerate(metrics):
        picked.append(f"coalesce(_m{i}.count, 0L) AS `{name}_count`")
        picked += [f"coalesce(_m{i}.{m}, 0D) AS `{name}_{m}`" for m in ("sum", "avg", "min", "max", "mode", "variance", "std")]
        at = {p: f"coalesce(_m{i}.pct[{k}], 0D)" for k, p in enumerate(percentiles)}
        if "p50" in at:
            picked.append(f"{at['p50']} AS `{name}_median`")
        picked += [f"{c} AS `{name}_{p}`" for p, c in at.items()]
    return long.groupBy(*keys).agg(*wide).selectExpr(*picked)


def iqr_bounds(df: DataFrame, metric: str) -> DataFrame:
    """Inter-quartile range and the 1.5 and 3 range fences of a metric that has p25 and p75."""
    low, high = F.col(f"{metric}_p25"), F.col(f"{metric}_p75")
    spread = high - low
    return df.withColumns(
        {
            f"{metric}_iqr": spread,
            f"{metric}_lower_iqr_bound": low - 1.5 * spread,
            f"{metric}_upper_iqr_bound": high + 1.5 * spread,
            f"{metric}_lower_outer_bound": low - 3.0 * spread,
            f"{metric}_upper_outer_bound": high + 3.0 * spread,
        }
    )


def as_struct(name: str, percentiles: Sequence[str] = tuple(PERCENTILES)) -> Column:
    """The flat columns of one metric as one struct."""
    return F.struct(*[F.col(f"{name}_{s}").alias(s) for s in (*MOMENTS, *percentiles)]).alias(name)


def statistic_ratio(df: DataFrame, part: str, whole: str, name: str) -> DataFrame:
    """Field-by-field ratio of two statistics, 0 where the divisor is 0."""
    from spindle.functions.scalars import ratio

    return df.withColumns({f"{name}_{s}": ratio(F.col(f"{part}_{s}"), F.col(f"{whole}_{s}")) for s in STATISTICS})


def statistic_scaled(df: DataFrame, metric: str, factor: float, name: str) -> DataFrame:
    """Every field of a statistic times a constant."""
    return df.withColumns({f"{name}_{s}": F.col(f"{metric}_{s}") * F.lit(factor) for s in STATISTICS})
