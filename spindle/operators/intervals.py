"""Dyadic tree over a numbered axis: intervals as few nodes, points as their ancestors, so that range joins are equi-joins.

The axis 0 .. 2**depth - 1 is halved again and again; node 1 is all of it, node i has the children 2i and 2i + 1. An interval
is the union of at most two nodes per level, a point lies in one node of every level, and it lies in an interval just if
exactly one of its nodes is one of the interval's. Both sides of a join grow by the depth only, however the intervals overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.ordered import asof, ordered
from spindle.session import stable


def depth_for(highest: int | None) -> int:
    """Levels below the root of an axis that ends at ``highest``."""
    return max(1, int(highest or 0).bit_length())


def _levels(depth: int) -> Column:
    return F.sequence(F.lit(0), F.lit(depth))


def nodes_of_point(point: Column, depth: int) -> Column:
    """The nodes above a point, itself included."""
    leaf = point.cast("long") + F.lit(1 << depth)
    return F.transform(_levels(depth), lambda k: F.call_function("shiftright", leaf, k))


def nodes_of_interval(lower: Column, upper: Column, depth: int) -> Column:
    """The fewest nodes whose points are ``lower`` to ``upper``; none if the interval is empty."""
    first, behind = lower.cast("long") + F.lit(1 << depth), upper.cast("long") + F.lit((1 << depth) + 1)

    def at(k: Column) -> Column:
        left = -F.call_function("shiftright", -first, k)  # rounded up
        right = F.call_function("shiftright", behind, k)
        return F.array(F.when((left % 2 == 1) & (left < right), left), F.when((right % 2 == 1) & (left < right), right - 1))

    return F.array_compact(F.flatten(F.transform(_levels(depth), at)))


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lower: str, upper: str) -> DataFrame:
    """Join every point with the intervals of its keys that hold it, both ends included; ``at`` and the ends are whole numbers
    from 0 on. Nulls match nothing."""
    highest = intervals.agg(F.max(upper)).first()[0]
    depth = depth_for(highest)
    inside = intervals.where((F.col(lower) <= F.col(upper)) & (F.col(upper) >= 0))
    spans = inside.withColumn("_node", F.explode(nodes_of_interval(F.greatest(F.col(lower), F.lit(0)), F.col(upper), depth)))
    rows = points.where(F.col(at).between(0, (1 << depth) - 1)).withColumn("_node", F.explode(nodes_of_point(F.col(at), depth)))
    return rows.join(spans, [*keys, "_node"]).drop("_node")


def far_pairs(starts: DataFrame, ends: DataFrame, keys: list[str], lower: str, upper: str, at: str, of: str, to: str, distance: int) -> DataFrame:
    """Pairs of a start and an end of its keys that lies at ``lower`` .. ``upper`` and whose whole number ``to`` differs from the
    start's ``of`` by ``distance`` or more. No other pair is ever formed: in each node the ends are numbered by ``to``, so
    those far below and far above a start are a first and a last run of numbers."""
    highest = ends.agg(F.max(at)).first()[0]
    depth = depth_for(highest)
    by = [*keys, "_node"]
    listed = ends.withColumn("_node", F.explode(nodes_of_point(F.col(at), depth)))
    listed = stable(ordered(listed, by, [to, at]).numbered("_place").frame())
    spans = starts.withColumn("_to", F.least(F.col(upper), F.lit((1 << depth) - 1))).where(F.col(lower) <= F.col("_to"))
    spans = stable(spans.withColumn("_node", F.explode(nodes_of_interval(F.col(lower), F.col("_to"), depth))).drop("_to"))
    facts = listed.select(*by, F.col(to).alias("_at"), F.col("_place").alias("_p"))
    sizes = listed.groupBy(*by).agg(F.max("_place").alias("_size"))
    low = asof(spans.withColumn("_at", F.col(of) - distance), facts, by, "_at", "_p").withColumnRenamed("_p", "_low")
    both = asof(low.withColumn("_at", F.col(of) + distance), facts, by, "_at", "_p", ahead=True).drop("_at")
    both = both.join(sizes, by)
    none = F.array().cast("array<bigint>")
    first = F.when(F.col("_low").isNotNull(), F.sequence(F.lit(1).cast("long"), F.col("_low"))).otherwise(none)
    last = F.when(F.col("_p").isNotNull(), F.sequence(F.col("_p"), F.col("_size"))).otherwise(none)
    places = both.withColumn("_place", F.explode(F.concat(first, last))).drop("_low", "_p", "_size")
    return places.join(listed, [*by, "_place"]).drop("_node", "_place")
