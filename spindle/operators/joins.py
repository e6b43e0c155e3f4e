"""Joins between traces, window lists, drifts and model groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.intervals import depth_for, nodes_of_interval, nodes_of_point
from spindle.operators.ordered import Groups, asof, ordered
from spindle.session import stable


def select_listed(characteristics: DataFrame, window_list: DataFrame) -> DataFrame:
    """Characteristics of the windows a list names, with the list's group and key."""
    return characteristics.join(window_list, "name")


def lookup(df: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of per-key values, 0 where there is none."""
    return Groups.measure(df, keys).join(df, values.select(*keys, *columns), "left").fillna(0, subset=list(columns))


def multiplier_pairs(buckets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The 1x window of a metric next to each of its k-x windows; the first name if several windows are 1x."""
    base = buckets.where(F.col("multiplier") == 1).groupBy("metric").agg(F.min(F.struct("name", *columns)).alias("_b"))
    base = base.select("metric", F.col("_b.name").alias("base_name"), *[F.col(f"_b.{c}").alias(f"base_{c}") for c in columns])
    return buckets.where(F.col("multiplier") != 1).join(base, "metric")


def positional(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """Give the i-th row of one table the i-th row of the other."""
    a = ordered(left, [], left_order).numbered("position").frame()
    b = ordered(right, [], right_order).numbered("position").frame()
    return a.join(b, "position")


def choose_group(df: DataFrame, groups: DataFrame, value: str = "size") -> DataFrame:
    """Model group of each row: its value lies in the group's ``lower``..``upper``; the nearest ``avg`` wins, then the first name.

    The winner depends on the value alone, so only distinct values are matched. Interval ends cut the axis into points
    and the gaps after them. An interval is a few nodes of a dyadic tree over these; a value asks each node above it for the
    nearest ``avg`` below and above, an as-of lookup, and keeps the nearest of all. Where no interval fits, a hash of the
    value picks. Null values get the first name.
    """
    names = ordered(groups, [], ["group"]).numbered("_pick").frame()
    values = df.select(value).where(F.col(value).isNotNull()).distinct()
    ends = groups.select(F.col("lower").cast("double").alias("_cut")).union(groups.select(F.col("upper").cast("double"))).where("_cut IS NOT NULL").distinct()
    cuts = stable(ordered(ends, [], ["_cut"]).numbered("_n").frame())
    depth = depth_for(2 * cuts.count() + 1)
    # a group covers its first to last point, and the gaps between them: cut n is place 2n, the gap behind it 2n + 1
    low = cuts.select(F.col("_cut").alias("lower"), (2 * F.col("_n")).alias("_first"))
    high = cuts.select(F.col("_cut").alias("upper"), (2 * F.col("_n")).alias("_last"))
    spans = groups.select("group", *[F.col(c).cast("double").alias(c) for c in ("avg", "lower", "upper")]).join(low, "lower").join(high, "upper")
    covers = spans.select("group", F.col("avg").alias("_at"), F.explode(nodes_of_interval(F.col("_first"), F.col("_last"), depth)).alias("_node"))
    facts = stable(covers.groupBy("_node", "_at").agg(F.min("group").alias("_g")).withColumn("_f", F.struct(F.col("_at").alias("avg"), "_g")).drop("_g"))
    placed = asof(values.withColumn("_at", F.col(value).cast("double")), cuts.withColumn("_at", F.col("_cut")).withColumn("_p", F.struct("_cut", "_n")), [], "_at", "_p")
    place = 2 * F.col("_p._n") + (F.col("_at") > F.col("_p._cut")).cast("int")
    asked = placed.where("_p IS NOT NULL").select(value, "_at", F.explode(nodes_of_point(place, depth)).alias("_node"))
    asked = asked.join(facts.select("_node").distinct(), "_node", "left_semi")
    below = asof(asked, facts, ["_node"], "_at", "_f").withColumnRenamed("_f", "_below")
    found = asof(below, facts, ["_node"], "_at", "_f", ahead=True)
    near = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.avg") - F.col("_at")).alias("d"), F.col(f"{c}._g").alias("g"))) for c in ("_below", "_f")]
    best = found.groupBy(value).agg(F.min(F.least(*near))["g"].alias("_best"))
    found = stable(values.join(best, value, "left"))
    count = F.broadcast(groups.agg(F.count(F.lit(1)).alias("_groups")))  # one row
    inside = found.where("_best is not null").select(value, F.col("_best").alias("group"), F.lit(True).alias("in_interval"))
    free = found.where("_best is null").join(count).withColumn("_pick", F.pmod(F.col(value).cast("long"), F.col("_groups")) + 1)
    outside = free.join(names, "_pick").select(value, "group", F.lit(False).alias("in_interval"))
    chosen = Groups.measure(df, [value]).join(df, inside.union(outside))
    first = F.broadcast(groups.agg(F.min("group").alias("group")))  # one row
    unknown = df.where(F.col(value).isNull()).join(first).withColumn("in_interval", F.lit(False))
    return chosen.unionByName(unknown)


def leaf_overlap(leaves: DataFrame, leaf_counts: DataFrame, rows_key: Sequence[str] = ()) -> DataFrame:
    """How many training rows of each model share a (tree, leaf) with the given rows, summed."""
    seen = leaves.groupBy(*rows_key, "tree", "leaf").agg(F.count(F.lit(1)).alias("_n"))
    joined = seen.join(leaf_counts, ["tree", "leaf"])
    return joined.groupBy(*rows_key, "model").agg(F.sum(F.col("_n") * F.col("count")).alias("overlap"))
