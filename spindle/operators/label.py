"""Labels for slow I/Os: knees, slow periods, outlier filters, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.scalars import finite, percent_text, round_half_even, throughput
from spindle.operators.distribution import KNEE_PERCENT, cdf_gain, tangent_knee
from spindle.operators.ordered import Groups, Ordered, key_join, ordered
from spindle.operators.selection import order_statistics
from spindle.operators.sequence import tail_state, with_future, with_history
from spindle.session import stable

# fixed values: rows looked back and ahead, and the drop that starts a slow period
N_HISTORY = 3
N_FUTURE = 3
THROUGHPUT_DROP = 1.7


def rounded_throughput(df: DataFrame) -> DataFrame:
    return df.withColumn("throughput", round_half_even(throughput(F.col("size"), F.col("latency"))))


def thresholds(df: DataFrame, keys: Sequence[str], groups: Groups | None = None) -> DataFrame:
    """Knee and median of latency and throughput per group."""
    groups = groups or Groups.measure(df, keys)
    metrics = {"latency": F.col("latency"), "throughput": F.col("throughput")}
    values = metrics | {f"finite_{m}": finite(c) for m, c in metrics.items()}
    stats = order_statistics(df, keys, values, [0.5, KNEE_PERCENT / 100], groups)
    medians = stats.select(*keys, *[F.col(f"{m}_pct")[0].alias(f"{m}_median") for m in metrics])
    cuts = stats.select(*keys, *[F.col(f"finite_{m}_pct")[1].alias(f"{m}_cut") for m in metrics])
    return key_join(medians, tangent_knee(df, keys, metrics, groups, cuts), keys)


def mark_slow(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ordered:
    """Rows with ``gc_start`` and ``tail`` (in a slow period), and the thresholds they were judged by.

    A period starts at a row that is not fast and whose throughput fell to 1/1.7 of the row before, and lasts until
    this and the next two rows are all at or above the median throughput.
    """
    groups = Groups.measure(df, keys)
    rows = rounded_throughput(df)
    rows = groups.join(rows, thresholds(rows, keys, groups))
    seq = with_future(with_history(ordered(rows, keys, order, groups), "throughput", 1), "throughput", N_FUTURE)
    drop = round_half_even(F.col("hist_0_throughput") / (F.col("throughput") + 0.1), 1)
    fast = (F.col("throughput") > F.col("throughput_knee")) | (F.col("latency") < F.col("latency_knee"))
    back = F.lit(True)
    for i in range(N_FUTURE):
        back = back & (F.col(f"future_{i}_throughput") >= F.col("throughput_median"))
    seq = seq.with_columns({"throughput_drop": drop}).with_columns({"gc_start": ~fast & (F.col("throughput_drop") >= THROUGHPUT_DROP)})
    seq = tail_state(seq, F.col("gc_start"), back)
    helpers = ["hist_0_throughput", *[f"future_{i}_throughput" for i in range(N_FUTURE)]]
    return seq.map(lambda part: part.drop(*helpers))


def mark_outliers(rows: Ordered) -> DataFrame:
    """``outlier`` 1: fast inside a slow period; 2: slow outside one; 3: a slow period of 3 rows or less once 1 and 2 are gone.

    The length of a period is found without dropping rows: slow rows so far minus those before the last kept fast
    row, counted from both sides.
    """
    first = (F.col("tail") == 1) & (F.col("latency") <= F.col("latency_median")) & (F.col("throughput") >= F.col("throughput_median"))
    second = (F.col("tail") == 0) & (F.col("latency") > F.col("latency_knee")) & (F.col("throughput") < F.col("throughput_median"))
    rows = rows.with_columns({"_o12": F.when(first, 1).when(second, 2).otherwise(0)})
    kept = F.col("_o12") == 0
    slow, border = kept & (F.col("tail") == 1), kept & (F.col("tail") == 0)
    for side, backward in (("_ahead", True), ("_behind", False)):
        rows = rows.running({side: ("sum", slow.cast("int"))}, backward=backward)
        rows = rows.running({f"{side}_base": ("last", F.when(border, F.col(side)))}, backward=backward)
    length = F.lit(-1)
    for side in ("_ahead", "_behind"):
        length = length + F.col(side) - F.coalesce(F.col(f"{side}_base"), F.lit(0))
    marked = rows.frame().withColumn("outlier", F.when(slow & (length <= N_HISTORY), 3).otherwise(F.col("_o12")))
    return marked.drop("_o12", "_ahead", "_ahead_base", "_behind", "_behind_base")


def label_slow(df: DataFrame, keys: Sequence[str], order: Sequence[str], filter_outliers: bool = False) -> DataFrame:
    """Add ``reject``: 1 inside a slow period. Optionally drop the outliers."""
    rows = mark_slow(df, keys, order)
    if filter_outliers:
        marked = mark_outliers(rows)
        return _labelled(marked.where(F.col("outlier") == 0), df)
    return _labelled(rows.frame(), df)


def _labelled(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*like.columns, F.col("tail").alias("reject"))


def label_with_outliers(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows with ``reject`` and ``outlier``; both the raw and the filtered label sets are filters on it."""
    marked = mark_outliers(mark_slow(df, keys, order))
    return marked.select(*df.columns, F.col("tail").alias("reject"), "outlier")


def filter_labelled(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the outliers of rows that already carry ``reject``; throughput is not rounded here."""
    groups = Groups.measure(df, keys)
    rows = df.withColumn("throughput", throughput(F.col("size"), F.col("latency"))).withColumn("tail", F.col("reject"))
    rows = groups.join(rows, thresholds(rows, keys, groups))
    marked = mark_outliers(ordered(rows, keys, order, groups))
    return marked.where(F.col("outlier") == 0).select(*df.columns)


def knee_label(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``slow`` = latency at or above its knee."""
    groups = Groups.measure(df, keys)
    knees = tangent_knee(df, keys, {"latency": F.col("latency")}, groups)
    return groups.join(df, knees.select(*keys, "latency_knee")).withColumn("slow", (F.col("latency") >= F.col("latency_knee")).cast("int"))


def label_report(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and shares of fast and slow I/Os and outliers, and the distribution gain of the accepted reads."""
    marked = stable(marked)
    kept, is_read, slow = F.col("outlier") == 0, F.col("io_type") == 1, F.col("reject") == 1
    counts = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_io"),
        F.count_if(is_read).alias("reads"),
        F.count_if(~is_read).alias("writes"),
        *[F.count_if(F.col("outlier") == i).alias(f"outlier{i}") for i in (1, 2, 3)],
        F.count_if(kept).alias("labelled"),
        F.count_if(kept & ~slow).alias("fast"),
        F.count_if(kept & slow).alias("slow"),
        F.count_if(kept & is_read).alias("labelled_reads"),
        F.count_if(kept & is_read & ~slow).alias("fast_reads"),
        F.count_if(kept & is_read & slow).alias("slow_reads"),
    )
    shares = counts.withColumns(
        {
            "labelled_percent": percent_text(F.col("labelled"), F.col("num_io")),
            "fast_percent": percent_text(F.col("fast"), F.col("labelled")),
            "slow_percent": percent_text(F.col("slow"), F.col("labelled")),
        }
    )
    gain = cdf_gain(marked.where(kept & is_read), keys, F.col("latency"), F.col("reject") == 0)
    return key_join(shares, gain, keys, "left").fillna("0%", subset=["cdf_gain"])


def label_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one of two labelings has, tagged with the side."""
    left, right = stable(left), stable(right)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
