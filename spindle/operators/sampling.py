"""Repeatable samples: rows are ranked by a hash of their id and a seed, so a lost task redraws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.ordered import Groups, key_join, ordered
from spindle.session import stable

# fixed values: rows per step of a gradual change, and per step between the ends of an incremental one
TRANSITION = 4
PER_TRANSITION = 5

_BUCKETS = 1_000_000


def draw(ids: Sequence[Column | str], seed: int = 42) -> Column:
    """Whole number in ``[0, 1e6)`` from ids and a seed; the first 13 hex digits of md5, so SQL can repeat it."""
    text = F.concat_ws("-", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), F.lit(_BUCKETS)).cast("long")


def thin(df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep about ``fraction`` of the rows; every stratum is thinned alike."""
    return df.where(draw(ids, seed) < round(fraction * _BUCKETS))


def thicken(df: DataFrame, factor: float, ids: Sequence[str], step_ms: float = 0.01, seed: int = 42, ts: str = "ts_record") -> DataFrame:
    """Repeat rows until there are about ``factor`` times as many; the i-th copy is moved by ``i * step_ms``."""
    whole, part = int(factor), factor - int(factor)
    copies = F.lit(whole) + F.when(draw(ids, seed) < round(part * _BUCKETS), 1).otherwise(0)
    spread = df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)) if whole else F.explode(F.sequence(F.lit(0), F.lit(0))))
    return spread.withColumn(ts, F.col(ts) + F.col("copy") * F.lit(step_ms))


def rescale(df: DataFrame, multiplier: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Raise or lower the I/O rate to ``multiplier`` times."""
    return thicken(df, multiplier, ids, seed=seed) if multiplier > 1 else thin(df, multiplier, ids, seed)


def rescale_report(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, reads and writes per window before and after a rescale."""

    def counts(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"num_io_{suffix}"),
            F.count_if(F.col("io_type") == 1).alias(f"read_{suffix}"),
            F.count_if(F.col("io_type") == 0).alias(f"write_{suffix}"),
        )

    joined = counts(before, "ori").join(counts(after, "rescaled"), list(keys), "left")
    return joined.fillna(0)


def ranked(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int, name: str = "pick") -> DataFrame:
    """Random position (from 1) within the stratum; ties in the draw fall back to the ids."""
    return ordered(df.withColumn("_draw", draw(ids, seed)), strata, ["_draw", *ids]).numbered(name).frame().drop("_draw")


def pick(df: DataFrame, strata: Sequence[str], ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` random rows per stratum, all if it has fewer."""
    return ranked(df, strata, ids, seed).where(F.col("pick") <= n)


def cap_rows(df: DataFrame, strata: Sequence[str], ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` random rows per stratum, for a side-by-side comparison."""
    return pick(df, strata, ids, n, seed).drop("pick")


def groups_larger_than(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups with more than ``n`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
    return Groups.measure(df, keys).join(df, sizes.drop("_n"), "left_semi")


def pool_list(buckets: DataFrame, n: int = 15, seed: int = 42) -> DataFrame:
    """Per metric and multiplier: the 1x window as key 1, then up to ``n`` random windows."""
    base = buckets.where(F.col("multiplier") == 1).groupBy("metric").agg(F.min("name").alias("name"))
    others = buckets.where(F.col("multiplier") != 1)
    picked = pick(others, ["metric", "multiplier"], ["name"], n, seed)
    later = picked.join(base.select("metric"), "metric", "left_semi").select("metric", "multiplier", (F.col("pick") + 1).alias("key"), "name")
    first = later.select("metric", "multiplier").distinct().join(base, "metric").select("metric", "multiplier", F.lit(1).cast("long").alias("key"), "name")
    return first.unionByName(later)


def sample_lists(buckets: DataFrame, samples: int = 5, seed: int = 42) -> DataFrame:
    """Per metric and sample: one random window of every multiplier."""
    drawn = buckets.withColumn("sample", F.explode(F.array(*[F.lit(i) for i in range(samples)])))
    picked = pick(drawn, ["metric", "sample", "multiplier"], ["sample", "name"], 1, seed)
    return picked.select("metric", "sample", "multiplier", "name")


def variations(buckets: DataFrame, count: int, windows: int, seed: int = 42) -> DataFrame:
    """Per variation: one random window of every (metric, multiplier), then ``windows`` of those in random order."""
    drawn = buckets.withColumn("variation", F.explode(F.array(*[F.lit(i) for i in range(count)])))
    chosen = pick(drawn, ["variation", "metric", "multiplier"], ["variation", "metric", "name"], 1, seed).drop("pick")
    listed = ranked(chosen, ["variation"], ["variation", "metric", "multiplier", "name"], seed + 1, "position")
    return listed.where(F.col("position") <= windows).select("variation", "position", "metric", "multiplier", "name")


def drift_schedules(buckets: DataFrame, per_step: int = 30, seed: int = 3003) -> DataFrame:
    """Window lists that drift suddenly, gradually, incrementally or back and forth between multipliers.

    Multipliers with more than ``per_step`` windows are ranked; a schedule is a small table of (multiplier rank, random
    position) rows, joined with the ranked windows. Every part of a schedule draws its own order.
    """
    large = groups_larger_than(buckets, ["metric", "multiplier"], per_step)
    steps = ordered(large.select("metric", "multiplier").distinct(), ["metric"], ["multiplier"]).numbered("rank").frame()
    steps = stable(steps.join(steps.groupBy("metric").agg(F.max("rank").alias("ranks")), "metric"))  # read by every part
    parts = _schedule_parts(steps, per_step)
    pool = ranked(large.join(steps.select("metric", "multiplier", "rank"), ["metric", "multiplier"]), ["metric", "multiplier"], ["metric", "name"], seed)
    placed = parts.join(pool, ["metric", "rank", "pick"])
    order = ["part", "half", "mix", "pick"]
    numbered = ordered(placed, ["metric", "type"], order).numbered("position").frame()
    return numbered.select("metric", "type", "position", "multiplier", "name")


def _schedule_parts(steps: DataFrame, per_step: int) -> DataFrame:
    """Rows (metric, type, part, half, mix, rank, pick): which random pick of which multiplier comes where."""

    def rows(type_: str, keep: Column, part: Column, half: Column, mix: Column, first: Column, last: Column) -> DataFrame:
        picks = F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>")))
        return steps.where(keep).select(
            "metric",
            F.lit(type_).alias("type"),
            part.cast("long").alias("part"),
            half.cast("long").alias("half"),
            mix.cast("long").alias("mix"),
            F.col("rank"),
            picks.alias("pick"),
        )

    one, zero = F.lit(1), F.lit(0)
    rank, ranks = F.col("rank"), F.col("ranks")
    block = int(per_step / 1.5)
    half_step = per_step // 2
    parts = [rows("sudden", one == 1, rank, zero, zero, one, F.lit(per_step))]
    # gradual: a block of the lower multiplier, then mixes with ever more rows of the next one
    parts.append(rows("gradual", ranks >= 3, rank, zero, zero, one, F.lit(block)))
    for i in range(1, TRANSITION):
        parts.append(rows("gradual", (ranks >= 3) & (rank > 1), rank - 1, F.lit(i), zero, one, F.lit(i)))
        parts.append(rows("gradual", (ranks >= 3) & (rank < ranks), rank, F.lit(i), one, one, F.lit(TRANSITION - i)))
    ends = (rank == 1) | (rank == ranks)
    parts.append(rows("incremental", ranks > 2, rank, zero, zero, one, F.when(ends, per_step).otherwise(PER_TRANSITION)))
    for j in (0, 1):
        first, last = (one, F.lit(half_step)) if j == 0 else (F.lit(per_step - half_step + 1), F.lit(per_step))
        parts.append(rows("recurring", (ranks >= 2) & (rank == 1), F.lit(2 * j), zero, zero, first, last))
        parts.append(rows("recurring", (ranks >= 2) & (rank == ranks), F.lit(2 * j + 1), zero, zero, first, last))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_up_missing_class(selected: DataFrame, everything: DataFrame, keys: Sequence[str], ids: Sequence[str], label: str = "reject", seed: int = 42) -> DataFrame:
    """Training rows per group; if one class is missing, random rows of it worth a quarter of the other class.

    If a quarter is more than there are, a quarter of those.
    """
    is_one = F.col(label) == 1
    have = selected.groupBy(*keys).agg(F.count_if(is_one).alias("_ones"), F.count_if(~is_one).alias("_zeros"))
    full = everything.groupBy(*keys).agg(F.count_if(is_one).alias("_all_ones"), F.count_if(~is_one).alias("_all_zeros"))
    need = key_join(have, full, keys)

    def quarter(other: Column, available: Column) -> Column:
        wanted = F.floor(other / 4)
        return F.when(wanted > available, F.floor(available / 4)).otherwise(wanted)

    missing = F.when(F.col("_zeros") == 0, F.lit(0)).when(F.col("_ones") == 0, F.lit(1))
    amount = F.when(F.col("_zeros") == 0, quarter(F.col("_ones"), F.col("_all_zeros"))).otherwise(quarter(F.col("_zeros"), F.col("_all_ones")))
    need = need.select(*keys, missing.alias("_class"), amount.alias("_amount")).where(F.col("_class").isNotNull())
    pool = Groups.measure(everything, keys).join(everything, need).where(F.col(label) == F.col("_class"))
    extra = ranked(pool, keys, ids, seed).where(F.col("pick") <= F.col("_amount"))
    return selected.unionByName(extra.select(*selected.columns))


def split_rows(df: DataFrame, ids: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test``: a repeatable random share of the rows."""
    return df.withColumn("is_test", draw(ids, seed) < round(test_share * _BUCKETS))


def split_by_time(df: DataFrame, keys: Sequence[str], order: Sequence[str], percent: int) -> DataFrame:
    """``is_test`` = 0 for the first ``percent`` of the rows in time order."""
    groups = Groups.measure(df, keys)
    numbered = ordered(df, keys, order, groups).numbered("_n").frame()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    joined = groups.join(numbered, sizes)
    return joined.withColumn("is_test", F.col("_n") > F.floor(F.col("_rows") * percent / 100)).drop("_n", "_rows")
