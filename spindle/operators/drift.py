"""Concept drifts in per-window series: sudden, gradual, incremental, recurring.

A series is a table (``series``, ``idx``, ``value``); thousands of them (device x metric x window size) run together.
Look-ups along a series (nearest run of a group, counts between two rows) are as-of lookups against small fact
tables, so no pair of concept ends scans the rows between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.scalars import value_group
from spindle.operators.intervals import far_pairs, within
from spindle.operators.ordered import Ordered, asof, ordered
from spindle.session import stable

KEY = ["series"]


#: Width of the slots through which ends are looked up between two rows.
SLOT_ROWS = 1024


@dataclass(frozen=True)
class DriftSettings:
    threshold: float = 250.0  # height of one value group
    offset: float = 50.0  # values up to offset + 1 form the first group
    window: int = 10  # rows of history in a mode histogram, besides the row itself
    stability: int = 14  # rows a concept must last
    reach: int = 3600  # longest drift, in rows
    recurring_rows: int = 8  # rows away from the concept that make its return a recurrence
    min_length: int = 0


def long_series(df: DataFrame, keys: list[str], index: str, metrics: list[str]) -> DataFrame:
    """Many metrics of many devices as one table of series."""
    from spindle.operators.characteristic import long_metrics

    long = long_metrics(df, [*keys, index], metrics)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("metric"))
    numbered = ordered(long.select(name.alias("series"), F.col(index).alias("_at"), "value"), KEY, ["_at"]).numbered("_n")
    return numbered.frame().select("series", (F.col("_n") - 1).alias("idx"), "value")


def index_series(df: DataFrame, order: str) -> DataFrame:
    """Number the rows of each series from 0."""
    numbered = ordered(df, KEY, [order]).numbered("_n").frame()
    return numbered.select("series", (F.col("_n") - 1).alias("idx"), "value")


def highest_mode(groups: Column) -> Column:
    """Most frequent element of an array, the smallest on a tie."""
    counted = F.transform(F.array_distinct(groups), lambda g: F.struct((-F.size(F.filter(groups, lambda x: x == g))).alias("n"), g.alias("g")))
    return F.array_min(counted)["g"]


def similar_mass(groups: Column, around: Column, distance: int, include_self: bool = True) -> Column:
    """Number of elements within ``distance`` of a group."""

    def near(x: Column) -> Column:
        inside = F.abs(x - around) <= distance
        return inside if include_self else inside & (x != around)

    return F.size(F.filter(groups, near))


def histogram(groups: Column) -> Column:
    """An array of groups as a map from group to count."""
    return F.map_from_entries(
        F.transform(F.array_sort(F.array_distinct(groups)), lambda g: F.struct(g, F.size(F.filter(groups, lambda x: x == g))))
    )


def mode_histograms(df: DataFrame, settings: DriftSettings) -> Ordered:
    """Group of every row, and the groups of the rows behind it (row included) and ahead of it."""
    w_rows = settings.window
    grouped = df.withColumn("group", value_group(F.col("value"), settings.threshold, settings.offset))
    return ordered(grouped, KEY, ["idx"]).shifted(
        {
            "trailing": lambda w: F.collect_list("group").over(w.rowsBetween(-w_rows, 0)),
            "leading": lambda w: F.collect_list("group").over(w.rowsBetween(0, w_rows - 1)),
            "prev_group": lambda w: F.lag("group").over(w),
        },
        before=w_rows,
        after=w_rows - 1,
    )


def stability(df: DataFrame, settings: DriftSettings) -> DataFrame:
    """Rows since the series last became unstable, rows since the group changed, and the trailing mode.

    A row resets the count if its group is in the minority both behind and ahead of it, the row before was not in
    its own majority either, and the two groups on each side do not make up for it.
    """
    half = settings.window // 2
    rows = mode_histograms(df, settings).with_columns({"_own": similar_mass(F.col("trailing"), F.col("group"), 0)})
    rows = rows.shifted({"_prev_own": lambda w: F.lag("_own").over(w)}, before=1)
    calm = (
        (F.size("trailing") < settings.window)
        | ((F.col("_own") > half) & (similar_mass(F.col("leading"), F.col("group"), 0) > half))
        | (F.col("_prev_own") > half)
        | (similar_mass(F.col("trailing"), F.col("group"), 2, include_self=False) > half)
    )
    first = F.col("prev_group").isNull()
    rows = rows.running(
        {
            "_reset": ("last", F.when(first | ~calm, F.col("idx"))),
            "_turn": ("last", F.when(first | (F.col("group") != F.col("prev_group")), F.col("idx"))),
        }
    )
    return rows.frame().select(
        "series",
        "idx",
        "value",
        "group",
        "trailing",
        "leading",
        highest_mode(F.col("trailing")).alias("mode"),
        (F.col("idx") - F.col("_reset")).alias("stability"),
        (F.col("idx") - F.col("_turn")).alias("stability_group"),
    )


def concept_ends(rows: DataFrame, settings: DriftSettings) -> DataFrame:
    """Last rows of concepts that lasted long enough."""
    marked = ordered(rows, KEY, ["idx"]).shifted({"_next": lambda w: F.lead("stability").over(w)}, after=1).frame()
    return marked.where((F.col("stability") >= settings.stability) & (F.col("_next") == 0)).drop("_next")


def candidate_pairs(ends: DataFrame, settings: DriftSettings) -> DataFrame:
    """Pairs of concept ends (a before b) with ``b - (a - stability of a) < reach``.

    ``b`` is less than ``reach`` rows after ``a``, so both are looked up in slots of that many rows and a slot's
    neighbour: an equi-join, and never more partners than there are ends within reach.
    """
    reach = settings.reach
    slot = F.floor(F.col("idx") / reach)
    left = ends.select(*KEY, F.col("idx").alias("start_idx"), F.col("stability").alias("_s"), slot.alias("_slot"))
    right = ends.select(*KEY, F.col("idx").alias("end_idx"), F.explode(F.array(slot, slot - 1)).alias("_slot"))
    near = (F.col("start_idx") < F.col("end_idx")) & (F.col("end_idx") - (F.col("start_idx") - F.col("_s")) < reach)
    return left.join(right, [*KEY, "_slot"]).where(near).drop("_slot", "_s")


@dataclass(frozen=True)
class RunIndex:
    """Rows by group, for lookups along a series: its runs, and their usable starts and ends."""

    runs: DataFrame  # series, group, run_start, run_end
    last: DataFrame  # series, last_idx

    @staticmethod
    def of(rows: DataFrame) -> RunIndex:
        runs = rows.select("series", "group", (F.col("idx") - F.col("stability_group")).alias("run_start"), "idx")
        runs = runs.groupBy("series", "group", "run_start").agg(F.max("idx").alias("run_end"))
        return RunIndex(runs, rows.groupBy("series").agg(F.max("idx").alias("last_idx")))

    def _facts(self, at: str, value: Column, keep: Column) -> DataFrame:
        return self.runs.join(self.last, KEY).where(keep).select("series", "group", F.col(at).alias("_at"), value.alias("_v"))

    def _find(self, probes: DataFrame, at: str, group: str, facts: DataFrame, ahead: bool) -> DataFrame:
        asked = probes.withColumns({"_at": F.col(at), "_wanted": F.col(group)})
        facts = facts.withColumnRenamed("group", "_wanted")
        return asof(asked, facts, ["series", "_wanted"], "_at", "_v", ahead=ahead).drop("_at", "_wanted")

    def nearest_before(self, probes: DataFrame, at: str, group: str, out: str) -> DataFrame:
        """Closest row at or before ``at`` (never row 0) with that group; ``at`` itself if there is none."""
        facts = self._facts("run_start", F.struct("run_start", "run_end"), F.col("run_end") >= 1)
        found = self._find(probes, at, group, facts, ahead=False)
        return found.withColumn(out, F.coalesce(F.least(F.col("_v.run_end"), F.col(at)), F.col(at))).drop("_v")

    def nearest_after(self, probes: DataFrame, at: str, group: str, out: str) -> DataFrame:
        """Closest row after ``at`` (before the last row) with that group; ``at`` itself if there is none."""
        asked = probes.withColumn("_next", F.col(at) + 1)
        facts = self._facts("run_end", F.struct("run_start", "run_end"), F.col("run_start") < F.col("last_idx"))
        found = self._find(asked, "_next", group, facts, ahead=True).join(self.last, KEY)
        row = F.when(F.col("_v").isNotNull(), F.greatest(F.col("_v.run_start"), F.col("_next")))
        return found.withColumn(out, F.coalesce(F.when(row < F.col("last_idx"), row), F.col(at))).drop("_v", "_next", "last_idx")

    def run_start_before(self, probes: DataFrame, at: str, group: str, out: str) -> DataFrame:
        """Start of the latest run of that group that began at or before ``at`` (not at row 0); else ``at``."""
        facts = self._facts("run_start", F.col("run_start"), F.col("run_start") >= 1)
        found = self._find(probes, at, group, facts, ahead=False)
        return found.withColumn(out, F.coalesce("_v", at)).drop("_v")

    def run_end_after(self, probes: DataFrame, at: str, group: str, out: str) -> DataFrame:
        """End of the first run of that group that ends at or after ``at`` (not at the last row); else ``at``."""
        facts = self._facts("run_end", F.col("run_end"), F.col("run_end") < F.col("last_idx"))
        found = self._find(probes, at, group, facts, ahead=True)
        return found.withColumn(out, F.coalesce("_v", at)).drop("_v")


def similar_rows(rows: DataFrame, settings: DriftSettings) -> DataFrame:
    """(series, mode, idx) where groups within 1 of ``mode`` fill at least half a window; a few modes per row."""
    near = F.array_distinct(F.flatten(F.transform("trailing", lambda g: F.array(g - 1, g, g + 1))))
    heavy = F.filter(near, lambda m: similar_mass(F.col("trailing"), m, 1) >= settings.window // 2)
    return rows.select("series", "idx", F.explode(heavy).alias("mode"))


def rows_between(probes: DataFrame, similar: DataFrame, mode: str, low: Column, high: Column, out: str) -> DataFrame:
    """Number of similar rows of a mode with ``low < idx < high``: difference of two running counts."""
    counted = ordered(similar, ["series", "mode"], ["idx"]).numbered("_n").frame()
    facts = counted.select("series", F.col("mode").alias("_m"), F.col("idx").alias("_at"), F.col("_n"))
    asked = probes.withColumns({"_m": F.col(mode), "_at": low})
    asked = asof(asked, facts, ["series", "_m"], "_at", "_n").withColumnRenamed("_n", "_before")
    asked = asof(asked.withColumn("_at", high), facts, ["series", "_m"], "_at", "_n", strict=True)
    n = F.coalesce("_n", F.lit(0)) - F.coalesce("_before", F.lit(0))
    return asked.withColumn(out, F.greatest(n, F.lit(0))).drop("_m", "_at", "_n", "_before")


def broken_between(probes: DataFrame, similar: DataFrame, mode: str, low: Column, high: Column, gap: int, out: str) -> DataFrame:
    """Whether the similar rows of a mode with ``low < idx < high`` form more than one interval.

    A run of them ends at the row after its last one, and runs at most ``gap`` rows apart merge. So there are two
    intervals if some similar row comes more than ``gap`` rows after that end, and a similar row of the same stretch
    comes before it.
    """
    marked = ordered(similar, ["series", "mode"], ["idx"]).shifted({"_prev": lambda w: F.lag("idx").over(w)}, before=1).frame()
    marked = marked.select("series", F.col("mode").alias("_m"), F.col("idx").alias("_at"), F.col("idx").alias("_i"), "_prev")
    late = marked.where(F.col("_i") - F.col("_prev") - 1 > gap)
    asked = probes.withColumns({"_m": F.col(mode), "_at": low})
    asked = asof(asked, marked, ["series", "_m"], "_at", "_i", ahead=True, strict=True).withColumnRenamed("_i", "_first")
    asked = asof(asked.withColumn("_at", high), late, ["series", "_m"], "_at", "_i", strict=True)
    return asked.withColumn(out, F.coalesce(F.col("_i") > F.col("_first"), F.lit(False))).drop("_m", "_at", "_i", "_first")


def merge_intervals(df: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Merge intervals whose start is at most ``gap`` after the end of the one before; the last end counts."""
    rows = ordered(df, keys, ["start", "end"]).shifted({"_prev_end": lambda w: F.lag("end").over(w)}, before=1)
    fresh = F.col("_prev_end").isNull() | (F.col("start") - F.col("_prev_end") > gap)
    rows = rows.running({"_piece": ("sum", fresh.cast("long"))}).frame()
    merged = rows.groupBy(*keys, "_piece").agg(
        F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"), F.count(F.lit(1)).alias("n")
    )
    return merged.drop("_piece")


def refine_pairs(pairs: DataFrame, rows: DataFrame, runs: RunIndex) -> DataFrame:
    """Move the start of each pair to where its concept began, and add the modes at both ends."""
    at_start = rows.select("series", F.col("idx").alias("start_idx"), F.col("group").alias("_g"), F.col("mode").alias("_m"), (F.col("idx") - F.col("stability")).alias("_from"))
    begin = rows.select("series", F.col("idx").alias("_from"), F.col("group").alias("_from_g"))
    # the refined start depends on the first end only
    starts = pairs.select("series", "start_idx").distinct().join(at_start, ["series", "start_idx"]).join(begin, ["series", "_from"])
    looked = runs.nearest_before(starts, "start_idx", "_m", "_near")
    looked = runs.run_start_before(looked, "_near", "_m", "_run")
    refined = (
        F.when(F.col("_from_g") == F.col("_m"), F.col("_from"))
        .when(F.col("_g") != F.col("_m"), F.col("_run"))
        .otherwise(F.col("start_idx"))
    )
    moved = looked.select("series", "start_idx", refined.alias("start"))
    mode = rows.select("series", F.col("idx").alias("start"), F.col("mode").alias("start_mode"))
    ends = rows.select("series", F.col("idx").alias("end_idx"), F.col("group").alias("end_group"), F.col("mode").alias("end_mode"))
    joined = pairs.join(moved, ["series", "start_idx"]).join(mode, ["series", "start"]).join(ends, ["series", "end_idx"])
    return joined.select("series", "start_idx", "end_idx", "start", "start_mode", "end_group", "end_mode")


def recurring_drifts(refined: DataFrame, similar: DataFrame, runs: RunIndex, settings: DriftSettings) -> DataFrame:
    """Pairs with equal modes that were away from the concept for more than ``recurring_rows`` rows."""
    same = refined.where(F.col("start_mode") == F.col("end_mode"))
    counted = rows_between(same, similar, "start_mode", F.col("start"), F.col("end_idx"), "_similar")
    away = F.greatest(F.col("end_idx") - F.col("start") - 1, F.lit(0)) - F.col("_similar")
    back = counted.withColumn("away_rows", away).where(F.col("away_rows") > settings.recurring_rows)
    back = runs.nearest_before(back, "end_idx", "start_mode", "_near")
    back = back.withColumn("_from", F.when(F.col("end_group") != F.col("start_mode"), F.col("_near")).otherwise(F.col("end_idx")))
    return runs.run_end_after(back, "_from", "start_mode", "end").select("series", "start_idx", "end_idx", "start", "end", "start_mode", "end_mode", "away_rows")


def shifting_pairs(refined: DataFrame, similar: DataFrame, runs: RunIndex, settings: DriftSettings) -> DataFrame:
    """Pairs whose modes are more than one apart, with run-aligned ends and whether the new mode came and went."""
    apart = refined.where(F.abs(F.col("start_mode") - F.col("end_mode")) > 1)
    marked = broken_between(apart, similar, "end_mode", F.col("start_idx"), F.col("end_idx"), settings.window, "is_gradual")
    marked = runs.run_start_before(marked, "start", "start_mode", "_start")
    marked = runs.run_end_after(marked, "end_idx", "end_mode", "end")
    return marked.drop("start").withColumnRenamed("_start", "start").select("series", "start_idx", "end_idx", "start", "end", "start_mode", "end_mode", "is_gradual")


def classify_shifts(shifts: DataFrame, recurring: DataFrame) -> DataFrame:
    """Gradual, sudden or incremental; a sudden drift that starts where a recurring one does is dropped."""
    distance = F.abs(F.col("start_mode") - F.col("end_mode"))
    limit = F.when((F.col("start_mode") == 0) | (F.col("end_mode") == 0), 2).otherwise(1)
    kind = F.when(F.col("is_gradual"), "gradual").when(distance > limit, "sudden").otherwise("incremental")
    typed = shifts.withColumn("type", kind)
    returning = recurring.select("series", "start").distinct().withColumn("_back", F.lit(True))
    joined = typed.join(returning, ["series", "start"], "left")
    return joined.where((F.col("type") != "sudden") | F.col("_back").isNull()).drop("_back")


def find_drifts(series: DataFrame, settings: DriftSettings = DriftSettings()) -> DataFrame:
    """All drifts of all series: ``series, start, end, type, start_mode, end_mode``."""
    rows = stable(stability(series, settings))  # read by every step below
    runs = RunIndex.of(rows)
    similar = similar_rows(rows, settings)
    pairs = stable(refine_pairs(candidate_pairs(concept_ends(rows, settings), settings), rows, runs))
    recurring = stable(recurring_drifts(pairs, similar, runs, settings))
    shifts = classify_shifts(shifting_pairs(pairs, similar, runs, settings), recurring)
    columns = ["series", "start", "end", "type", "start_mode", "end_mode"]
    found = recurring.withColumn("type", F.lit("recurring")).select(*columns).unionByName(shifts.select(*columns))
    return found.where(F.col("end") - F.col("start") >= settings.min_length)


def mode_trend(refined: DataFrame, rows: DataFrame, flat: float = 0.01) -> DataFrame:
    """Least-squares slope of the start mode's share along each pair, and whether it falls or rises as it should.

    The sums of the regression over a pair's rows are differences of running sums per (series, mode); only rows whose
    histogram holds the mode add to them.
    """
    counted = rows.select("series", "idx", F.explode(histogram(F.col("trailing"))).alias("_mode", "_y"))
    counted = ordered(counted, ["series", "_mode"], ["idx"]).running({"_s": ("sum", F.col("_y")), "_sx": ("sum", F.col("_y") * F.col("idx"))}).frame()
    facts = stable(counted.select("series", "_mode", F.col("idx").alias("_at"), F.struct("_s", "_sx").alias("_f")))
    spans = refined.select("series", "start_idx", "end_idx", "start_mode", "end_mode").withColumn("_mode", F.col("start_mode"))
    spans = asof(spans.withColumn("_at", F.col("start_idx")), facts, ["series", "_mode"], "_at", "_f").withColumnRenamed("_f", "_before")
    spans = asof(spans.withColumn("_at", F.col("end_idx")), facts, ["series", "_mode"], "_at", "_f")

    def between(name: str) -> Column:
        return F.coalesce(F.col(f"_f.{name}"), F.lit(0)) - F.coalesce(F.col(f"_before.{name}"), F.lit(0))

    # x counts the pair's rows from 0
    n = F.col("end_idx") - F.col("start_idx")
    sum_y, sum_xy = between("_s"), between("_sx") - (F.col("start_idx") + 1) * between("_s")
    sum_x, sum_xx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = F.try_divide(n * sum_xy - sum_x * sum_y, n * sum_xx - sum_x * sum_x)
    fitted = spans.select("series", "start_idx", "end_idx", "start_mode", "end_mode", n.alias("rows"), slope.alias("slope"))
    steep = F.abs(F.col("slope")) >= flat
    leaving = F.when(F.col("start_mode") < F.col("end_mode"), F.col("slope") <= 0).otherwise(F.col("slope") >= 0)
    return fitted.withColumn("is_trend", F.coalesce(steep & leaving, F.lit(False)))


def selected_drifts(drifts: DataFrame) -> DataFrame:
    """Drift list as written for review: nothing is selected yet."""
    return drifts.select("series", "start", "end", "type", F.lit("n").alias("should_use"))


def slice_drifts(series: DataFrame, drifts: DataFrame, closed: bool = False) -> DataFrame:
    """Rows of the series inside each drift; the last row belongs to it only if ``closed``.

    A drift is a few nodes of a dyadic tree over the rows: an equi-join whose output is the result.
    """
    ends = drifts.withColumn("_last", F.col("end") if closed else F.col("end") - 1)
    return within(series, ends, KEY, "idx", "start", "_last").drop("_last")


# --- first version of the finder -------------------------------------------------------------------------------


def stability_v1(df: DataFrame, settings: DriftSettings) -> DataFrame:
    """Trailing mode, smallest and largest group; stability counts rows since the mode last changed."""
    w_rows = settings.window
    grouped = df.withColumn("group", value_group(F.col("value"), settings.threshold, settings.offset))
    rows = ordered(grouped, KEY, ["idx"]).shifted(
        {
            "trailing": lambda w: F.collect_list("group").over(w.rowsBetween(-w_rows, 0)),
            "leading": lambda w: F.collect_list("group").over(w.rowsBetween(0, w_rows)),
            "min_group": lambda w: F.min("group").over(w.rowsBetween(-w_rows, 0)),
            "max_group": lambda w: F.max("group").over(w.rowsBetween(-w_rows, 0)),
            "prev_group": lambda w: F.lag("group").over(w),
        },
        before=w_rows,
        after=w_rows,
    )
    rows = rows.with_columns({"mode": highest_mode(F.col("trailing")), "next_mode": highest_mode(F.col("leading"))})
    rows = rows.shifted({"prev_mode": lambda w: F.lag("mode").over(w)}, before=1)
    fell, rose = F.col("mode") < F.col("prev_mode"), F.col("mode") > F.col("prev_mode")
    first = F.col("prev_mode").isNull()
    rows = rows.running(
        {
            "_inc": ("last", F.when(fell, F.col("idx") - 1)),
            "_dec": ("last", F.when(rose, F.col("idx") - 1)),
            "_reset": ("last", F.when(first | fell | rose, F.col("idx"))),
            "_turn": ("last", F.when(first | (F.col("group") != F.col("prev_group")), F.col("idx"))),
        }
    )
    return rows.frame().select(
        "series", "idx", "value", "group", "mode", "next_mode", "min_group", "max_group",
        F.coalesce("_inc", F.lit(-1)).cast("long").alias("increasing_idx"),
        F.coalesce("_dec", F.lit(-1)).cast("long").alias("decreasing_idx"),
        (F.col("idx") - F.col("_reset")).alias("stability"),
        (F.col("idx") - F.col("_turn")).alias("stability_group"),
    )


def count_turns(rows: DataFrame) -> DataFrame:
    """How often the markers of a series moved: downward first, upward otherwise."""
    marked = ordered(rows, KEY, ["idx"]).shifted(
        {"_pi": lambda w: F.lag("increasing_idx").over(w), "_pd": lambda w: F.lag("decreasing_idx").over(w)}, before=1
    )
    moved = F.coalesce(F.col("increasing_idx") != F.col("_pi"), F.lit(False))
    other = F.coalesce(F.col("decreasing_idx") != F.col("_pd"), F.lit(False))
    return marked.frame().groupBy("series").agg(
        F.count_if(moved).alias("increasing_drifts"), F.count_if(~moved & other).alias("decreasing_drifts")
    )


def steady_until(rows: DataFrame) -> DataFrame:
    """For every row of a series, the first rows behind it at which a rise (``rise_ends``) and a steady change (``steady_ends``) end.

    A rise ends at the first step that does not rise. That step is not held against falling: from there on the change
    stays steady as long as every further step falls. Null where it goes on to the end of the series.
    """
    steps = ordered(rows, KEY, ["idx"]).shifted({"_prev": lambda w: F.lag("mode").over(w)}, before=1)
    up, down = F.col("mode") > F.col("_prev"), F.col("mode") < F.col("_prev")
    marked = {"_not_up": ("min", F.when(~up, F.col("idx"))), "_not_down": ("min", F.when(~down, F.col("idx")))}
    next_ = steps.running(marked, exclusive=True, backward=True).frame().select("series", "idx", "_not_up", "_not_down")
    next_ = stable(next_)
    after = next_.select("series", F.col("idx").alias("_not_up"), F.col("_not_down").alias("steady_ends"))
    return next_.join(after, ["series", "_not_up"], "left").select("series", "idx", F.col("_not_up").alias("rise_ends"), "steady_ends")


def monotone_between(pairs: DataFrame, rows: DataFrame, start: str, end: str) -> DataFrame:
    """Whether the mode rises at every step from ``start`` to ``end``, and whether it falls at every step behind the first one
    that does not rise (see ``steady_until``)."""
    until = steady_until(rows).withColumnRenamed("idx", start)
    rising, steady = (F.coalesce(F.col(c) > F.col(end), F.lit(True)) for c in ("rise_ends", "steady_ends"))
    joined = pairs.join(until, ["series", start]).withColumns({"is_increasing": rising, "is_decreasing": rising | steady})
    return joined.drop("rise_ends", "steady_ends")


def find_drifts_v1(series: DataFrame, settings: DriftSettings) -> DataFrame:
    """Recurring (same mode), incremental (monotone mode) and sudden (group step of 2 or more) drifts between stationary ends.

    A start has one recurring drift, to the first end that returns, and other drifts to ends before it. That end is
    looked up along the series, so only ends that can still count are joined; a drift may be of any length.
    """
    rows = stable(stability_v1(series, settings))
    ends = concept_ends(rows, settings)
    left = ends.select("series", F.col("idx").alias("end_a"), (F.col("idx") - F.col("stability")).alias("_from"))
    at = rows.select("series", F.col("idx").alias("_from"), F.col("group").alias("_g"))
    runs = RunIndex.of(rows)
    starts = runs.run_start_before(left.join(at, ["series", "_from"]), "_from", "_g", "start")
    first = rows.select("series", F.col("idx").alias("start"), F.col("mode").alias("start_mode"), F.col("group").alias("start_group"))
    begins = starts.groupBy("series", "start").agg(F.min("end_a").alias("end_a")).join(first, ["series", "start"])
    begins = begins.withColumn("_from", F.greatest(F.col("end_a") + 1, F.col("start") + settings.min_length))
    # the first end that returns: in the group of the start, or after a steady row of that group
    steady = rows.where((F.col("stability") > 0) & (F.col("stability_group") > settings.stability))
    facts = steady.select("series", F.col("group").alias("start_group"), F.col("idx").alias("_at"), F.col("idx").alias("_i"))
    back = ends.select("series", F.col("mode").alias("start_mode"), F.col("group").alias("start_group"), F.col("idx").alias("_at"), F.col("idx").alias("_e"))
    seen = asof(begins.withColumn("_at", F.col("_from")), back, ["series", "start_mode", "start_group"], "_at", "_e", ahead=True).withColumnRenamed("_e", "_home")
    seen = asof(seen.withColumn("_at", F.col("start")), facts, ["series", "start_group"], "_at", "_i", ahead=True)
    seen = seen.withColumn("_at", F.greatest(F.col("_from"), F.col("_i") + 1))
    seen = asof(seen, back.drop("start_group"), ["series", "start_mode"], "_at", "_e", ahead=True).drop("_at")
    seen = stable(seen.withColumn("_seen", F.least("_home", F.when(F.col("_i").isNotNull(), F.col("_e")))).drop("_e", "_i", "end_a"))
    again = asof(seen.where("_seen is not null").withColumn("_at", F.col("_seen")), facts, ["series", "start_group"], "_at", "_i", strict=True)
    reached = F.when(F.col("_home") == F.col("_seen"), F.col("_seen")).otherwise(F.col("_i"))
    recurring = again.select("series", "start", reached.alias("end"))  # one per start
    # the other drifts of a start end before that: neither a later step nor a later jump counts
    final = ends.groupBy("series").agg(F.max("idx").alias("_final"))
    begins = seen.join(final, "series").withColumn("_to", F.coalesce(F.col("_seen") - 1, "_final")).drop("_final", "_home", "_seen", "_at")
    until = steady_until(rows).select("series", F.col("idx").alias("start"), "steady_ends")
    begins = stable(begins.join(until, ["series", "start"]).where(F.col("_from") <= F.col("_to")))
    right = ends.select("series", F.col("idx").alias("end_idx"), F.col("mode").alias("end_mode"), F.col("group").alias("end_group"))
    # up to where the change is no more steady, every end of another mode is an incremental drift; behind that, far groups count
    steady = begins.withColumn("_last", F.least("_to", F.coalesce(F.col("steady_ends") - 1, "_to")))
    incremental = within(right, steady, KEY, "end_idx", "_from", "_last").where(F.col("start_mode") != F.col("end_mode"))
    incremental = incremental.select("series", "start", F.col("end_idx").alias("end"), F.lit("incremental").alias("type"))
    broken = begins.where("steady_ends IS NOT NULL").withColumn("_first", F.greatest("_from", "steady_ends"))
    jumps = far_pairs(broken, right, KEY, "_first", "_to", "end_idx", "start_group", "end_group", 2)
    jumps = jumps.where(F.col("start_mode") != F.col("end_mode")).select("series", "start", "end_idx", "end_group")
    jumps = runs.run_end_after(stable(jumps), "end_idx", "end_group", "end")
    found = recurring.select("series", "start", "end", F.lit("recurring").alias("type")).unionByName(incremental)
    return found.unionByName(jumps.select("series", "start", "end", F.lit("sudden").alias("type")))


def drop_repeated(drifts: DataFrame) -> DataFrame:
    """Of consecutive drifts with the same start and type only the last is kept."""
    rows = ordered(drifts, KEY, ["start", "end", "type"]).shifted(
        {
            "_ps": lambda w: F.lag("start").over(w),
            "_ns": lambda w: F.lead("start").over(w),
            "_nt": lambda w: F.lead("type").over(w),
        },
        before=1,
        after=1,
    )
    repeated = F.coalesce((F.col("_ns") == F.col("start")) & (F.col("_nt") == F.col("type")), F.lit(False))
    return rows.frame().where(~repeated).drop("_ps", "_ns", "_nt")


# --- trends ----------------------------------------------------------------------------------------------------


def tolerant_trend(segments: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per segment: whether the run-collapsed values move from first to last without a step back of more than 1."""
    rows = ordered(segments, keys, [order]).shifted({"_prev": lambda w: F.lag(value).over(w)}, before=1).frame()
    back = F.col(value) - F.col("_prev")
    judged = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(value, order).alias("first_mode"),
        F.max_by(value, order).alias("last_mode"),
        F.coalesce(F.min(back), F.lit(0)).alias("_down"),
        F.coalesce(F.max(back), F.lit(0)).alias("_up"),
    )
    rising = F.col("first_mode") < F.col("last_mode")
    held = F.when(rising, F.col("_down") >= -1).otherwise(F.col("_up") <= 1)
    moved = F.col("first_mode") != F.col("last_mode")
    return judged.withColumn("is_incremental", (F.col("rows") >= 2) & moved & held).drop("_down", "_up")


def concordance(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per segment: earlier-smaller minus earlier-larger pairs of whole numbers >= 0, without forming pairs.

    Two different numbers part at one binary digit, below a common prefix. So for every digit the rows with a 1
    count the earlier rows with a 0 and the same prefix, and the other way round: rows x digits instead of rows
    squared.
    """
    top = df.agg(F.max(value)).first()[0]
    digits = max(int(top or 0).bit_length(), 1)
    v = F.col(value).cast("long")
    rows = df.select(*keys, F.col(order).alias("_o"), v.alias("_v"), F.explode(F.array(*[F.lit(i) for i in range(digits)])).alias("_digit"))
    rows = rows.withColumns(
        {
            "_prefix": F.expr("shiftright(_v, _digit + 1)"),
            "_bit": F.expr("shiftright(_v, _digit) & 1"),
        }
    )
    ones = ("sum", F.col("_bit"))
    zeros = ("sum", 1 - F.col("_bit"))
    seen = ordered(rows, [*keys, "_digit", "_prefix"], ["_o"]).running({"_ones": ones, "_zeros": zeros}, exclusive=True).frame()
    score = F.when(F.col("_bit") == 1, F.coalesce("_zeros", F.lit(0))).otherwise(-F.coalesce("_ones", F.lit(0)))
    return seen.groupBy(*keys).agg(F.sum(score).cast("long").alias("s"))


def mann_kendall(segments: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall trend test of whole-number values per segment, tie-corrected."""
    s = concordance(segments, keys, order, value)
    ties = segments.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    t = F.col("_t").cast("double")
    sizes = ties.groupBy(*keys).agg(F.sum("_t").alias("rows"), F.sum(t * (t - 1) * (2 * t + 5)).alias("_ties"))
    n = F.col("rows").cast("double")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    joined = s.join(sizes, keys).withColumn("_var", variance)
    z = F.when(F.col("s") == 0, 0.0).otherwise(F.try_divide(F.col("s") - F.signum(F.col("s").cast("double")), F.sqrt("_var")))
    joined = joined.withColumn("z", F.coalesce(z, F.lit(0.0)))
    joined = joined.withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
    significant = F.col("p") < alpha
    trend = F.when(significant & (F.col("z") > 0), "increasing").when(significant & (F.col("z") < 0), "decreasing").otherwise("no trend")
    return joined.withColumn("trend", trend).select(*keys, "rows", "s", "z", "p", "trend")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for z >= 0 (Zelen and Severo's polynomial, error below 1e-7)."""
    # fixed values: coefficients of the polynomial
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _first_trend_end(modes: np.ndarray, min_length: int, alpha: float, complete: bool) -> int:
    """Smallest length of a trending segment that starts at the first mode, 0 if there is none.

    Once the modes have stepped back by more than 1 both ways no later end can trend. If the rows end before that and
    are not ``complete``, the answer is -1.
    """
    counts, ties, s, down, up = {}, 0.0, 0, 0, 0
    first = last = modes[0]
    for n, value in enumerate(modes.tolist(), start=1):
        down, up, last = min(down, value - last), max(up, value - last), value
        if down < -1 and up > 1:
            return 0
        s += sum(c * ((value > other) - (value < other)) for other, c in counts.items())
        t = counts.get(value, 0)
        ties += (t + 1) * t * (2 * t + 7) - t * (t - 1) * (2 * t + 5)
        counts[value] = t + 1
        if n <= min_length or first == value or (down < -1 if first < value else up > 1):
            continue
        variance = (n * (n - 1) * (2 * n + 5) - ties) / 18
        if variance > 0 and math.erfc(max(abs(s) - 1, 0) / math.sqrt(variance) / math.sqrt(2)) < alpha and s != 0:
            return n
    return 0 if complete else -1


def trending_segments(rows: DataFrame, min_length: int = 50, slot_rows: int = 3600, alpha: float = 0.05) -> DataFrame:
    """Non-overlapping segments whose mode moves one way, found from left to right: ``series, start, end``.

    The first trending end of every start is found independently, in slots of ``slot_rows`` rows that also see the
    next slot. Starts whose answer lies further on are looked at again in slots of twice the size, until none is left,
    so segments may be of any length. Which starts the left-to-right scan picks follows from the starts it jumps to;
    the chain is followed in doubling steps.
    """
    # a segment ends before the last row of its series
    last = rows.groupBy("series").agg(F.max("idx").alias("_last"))
    rows = stable(rows.select("series", "idx", "mode").join(last, "series").where(F.col("idx") < F.col("_last")))
    found, open_, width = None, rows.select("series", "idx").withColumn("_open", F.lit(True)), slot_rows
    while not open_.isEmpty():

        def ends(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("idx")
            idx, modes = part["idx"].to_numpy(), part["mode"].to_numpy()
            mine = np.flatnonzero((idx // width == key[1]) & part["_open"].to_numpy(bool))
            complete = bool(len(idx) and idx[-1] + 1 >= part["_last"].iloc[0])
            lengths = np.array([_first_trend_end(modes[i:], min_length, alpha, complete) for i in mine], dtype="int64")
            return pd.DataFrame({"series": key[0], "start": idx[mine], "length": lengths})[lengths != 0]

        slot = F.floor(F.col("idx") / width)
        tagged = rows.join(open_, ["series", "idx"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
        wanted = open_.select("series", slot.alias("_slot")).distinct()
        seen = tagged.withColumn("_slot", F.explode(F.array(slot, slot - 1))).join(wanted, ["series", "_slot"], "left_semi")
        judged = stable(seen.groupBy("series", "_slot").applyInPandas(ends, "series string, start bigint, length bigint"))
        sure = judged.where("length > 0").select("series", "start", (F.col("start") + F.col("length")).alias("end"))
        found = sure if found is None else found.unionByName(sure)
        open_, width = judged.where("length < 0").select("series", F.col("start").alias("idx"), F.lit(True).alias("_open")), 2 * width
    if found is None:
        return rows.select("series", F.col("idx").alias("start"), F.col("idx").alias("end"))  # no rows
    found = stable(found)
    # from a picked segment the scan goes on one row after its end, to the next start that has an end
    facts = found.select("series", F.col("start").alias("_at"), F.col("start").alias("_to"))
    hops = asof(found.withColumn("_at", F.col("end") + 1), facts, KEY, "_at", "_to", ahead=True)
    hops = stable(hops.select("series", F.col("start").alias("_from"), "_to").where(F.col("_to").isNotNull()))
    picked = stable(found.groupBy("series").agg(F.min("start").alias("start")))
    while not hops.isEmpty():
        further = picked.join(hops.withColumnRenamed("_from", "start"), ["series", "start"]).select("series", F.col("_to").alias("start"))
        picked = stable(picked.union(further).distinct())
        second = hops.select("series", F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        hops = stable(hops.join(second, ["series", "_to"]).select("series", "_from", F.col("_then").alias("_to")))
    return found.join(picked, ["series", "start"], "left_semi").select("series", "start", "end")
