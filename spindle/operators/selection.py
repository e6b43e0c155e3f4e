"""Exact percentiles and modes of large groups, without shuffling or sorting their values.

1. A quantile sketch, which merges across tasks, gives every wanted rank a bracket of values.
2. One counting pass proves the brackets: per group it counts the values between two brackets, and the distinct values
   within them. Only these counts are shuffled.
3. Running totals over the counts say which value stands at each rank. A rank that fell between two brackets sends its
   group through the counts of all its distinct values.

The mode is found likewise: the most frequent value within a bracket is a lower bound; values are counted by hash bucket,
and only the values of buckets that hold as many are counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.ordered import Groups, fits, key_join, ordered
from spindle.session import stable

#: The sketch's ranks are off by at most 1 / ACCURACY of the rows; brackets reach twice as far to either side.
ACCURACY = 2000
BUCKETS = 4096


def _between(probs: Sequence[float], total: Column, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Linear interpolation between the values at the ranks around each position."""
    out = []
    for p, lo, hi in zip(probs, low, high):
        position = (total - 1) * F.lit(float(p))
        share = position - F.floor(position)
        out.append(F.when(lo == hi, lo).otherwise(lo * (1 - share) + hi * share))
    return F.array(*out)


def _brackets(values: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, total, lows, highs): values between which each rank lies, both ascending with the probabilities."""
    margin = 2 / ACCURACY
    below, above = [p - margin for p in probs], [p + margin for p in probs]
    cuts = F.percentile_approx("v", [min(max(p, 0.0), 1.0) for p in (*below, *above)], ACCURACY).alias("_cuts")
    sketch = values.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("_min"), F.max("v").alias("_max"), cuts)
    lows = [F.col("_min") if p <= 0 else F.col("_cuts")[i] for i, p in enumerate(below)]
    highs = [F.col("_max") if p >= 1 else F.col("_cuts")[len(probs) + i] for i, p in enumerate(above)]
    return stable(sketch.select(*by, "total", F.array(*lows).alias("lows"), F.array(*highs).alias("highs")))


def _counted(values: DataFrame, by: Sequence[str], brackets: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(by, j, gap, x, n): counts of the distinct values in brackets, and of all values behind the j-th one (gap 1, x null)."""
    placed = key_join(values, brackets.drop("total"), by, small=fits(brackets))
    j = sum(((F.col("lows")[i] <= F.col("v")).cast("int") for i in range(len(probs))), F.lit(0))
    placed = placed.withColumn("j", j)
    inside = (F.col("j") > 0) & (F.col("v") <= F.get("highs", F.col("j") - 1))
    placed = placed.select(*by, "j", F.when(inside, 0).otherwise(1).alias("gap"), F.when(inside, F.col("v")).alias("x"))
    return stable(placed.groupBy(*by, "j", "gap", "x").agg(F.count(F.lit(1)).alias("n")))


def _modes(values: DataFrame, by: Sequence[str], least: DataFrame) -> DataFrame:
    """(by, mode): the smallest of the most frequent values. ``least``: (by, most), what some value reaches."""
    hashed = values.withColumn("_bucket", F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).cast("int"))
    buckets = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_held"))
    buckets = key_join(buckets, least, by, small=fits(least)).where(F.col("_held") >= F.col("most")).select(*by, "_bucket")
    buckets = stable(buckets)
    counts = key_join(hashed, buckets, [*by, "_bucket"], "left_semi", small=fits(buckets)).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def select_ranks(values: DataFrame, by: Sequence[str], probs: Sequence[float], limit: int, mode: bool = False) -> DataFrame:
    """(by, pct, mode) of the rows (by, v), whose v is not null; pct has a value for every probability, in order.

    ``limit`` is the number of rows that one task may sort. Null keys are groups like others.
    """
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    rising = [probs[i] for i in order]
    values = values.select(*by, (F.col("v") + F.lit(0.0)).alias("v"))  # -0.0 counts as 0.0
    brackets = _brackets(values, by, rising)
    counts = _counted(values, by, brackets, rising)
    ranked = ordered(counts, by, ["j", "gap", "x"], Groups.measure(counts, by, limit, staged=True))
    ranked = key_join(ranked.running({"upto": ("sum", F.col("n"))}).frame(), brackets.select(*by, "total"), by, small=fits(brackets))
    at = F.struct("j", "gap", "x")
    picks = [F.max(F.when(F.col("gap") == 0, F.col("n"))).alias("most"), F.first("total").alias("total")]
    for i, p in enumerate(rising):
        position = (F.col("total") - 1) * F.lit(float(p))
        picks += [F.min(F.when(F.col("upto") > f(position), at)).alias(f"{side}{i}") for side, f in (("lo", F.floor), ("hi", F.ceil))]
    picked = stable(ranked.groupBy(*by).agg(*picks))
    names = [f"{side}{i}" for i in range(len(rising)) for side in ("lo", "hi")]
    lost = sum((F.col(f"{n}.gap") for n in names), F.lit(0)) > 0
    place = {p: i for i, p in enumerate(order)}
    low, high = ([F.col(f"{side}{place[i]}.x") for i in range(len(probs))] for side in ("lo", "hi"))
    found = picked.where(~lost).select(*by, _between(probs, F.col("total"), low, high).alias("pct"))
    failed = picked.where(lost).select(*by)
    if not failed.isEmpty():
        failed = stable(failed)
        rest = key_join(values, failed, by, "left_semi", small=fits(failed))
        found = found.unionByName(rank_all(rest, by, probs, limit))
    if mode:
        # without a value in any bracket, one row is what every value has at least
        least = stable(picked.select(*by, F.coalesce("most", F.lit(1)).alias("most")))
        found = key_join(found, _modes(values, by, least), by)
    return found


def rank_all(values: DataFrame, by: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    """(by, pct) from the counts of all distinct values."""
    counts = stable(values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")))
    ranked = ordered(counts, by, ["v"], Groups.measure(counts, by, limit, staged=True)).running({"upto": ("sum", F.col("n"))}).frame()
    totals = stable(counts.groupBy(*by).agg(F.sum("n").alias("total")))  # one row per group
    ranked = key_join(ranked, totals, by, small=fits(totals))
    picks = [F.first("total").alias("total")]
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * F.lit(float(p))
        picks += [F.min(F.when(F.col("upto") > f(position), F.col("v"))).alias(f"{side}{i}") for side, f in (("lo", F.floor), ("hi", F.ceil))]
    low, high = ([F.col(f"{side}{i}") for i in range(len(probs))] for side in ("lo", "hi"))
    return ranked.groupBy(*by).agg(*picks).select(*by, _between(probs, F.col("total"), low, high).alias("pct"))


def order_statistics(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], probs: Sequence[float], groups: Groups | None = None, mode: bool = False
) -> DataFrame:
    """Exact linear-interpolated percentiles (``<name>_pct`` array) and smallest mode (``<name>_mode``) per group."""
    groups = groups or Groups.measure(df, keys)
    parts = []
    cold, hot = groups.cold_part(df), groups.hot_part(df)
    if cold is not None:
        columns = [F.percentile(c.cast("double"), list(probs)).alias(f"{n}_pct") for n, c in values.items()]
        if mode:
            columns += [F.mode(c.cast("double"), True).alias(f"{n}_mode") for n, c in values.items()]
        parts.append(cold.groupBy(*keys).agg(*columns))
    if hot is not None:
        pairs = [F.struct(F.lit(n).alias("_name"), c.cast("double").alias("v")) for n, c in values.items()]
        long = hot.select(*keys, F.inline(F.array(*pairs))).where(F.col("v").isNotNull())
        found = select_ranks(long, [*keys, "_name"], probs, groups.limit, mode)
        wide = [F.max(F.when(F.col("_name") == n, F.col("pct"))).alias(f"{n}_pct") for n in values]
        if mode:
            wide += [F.max(F.when(F.col("_name") == n, F.col("mode"))).alias(f"{n}_mode") for n in values]
        parts.append(found.groupBy(*keys).agg(*wide))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
