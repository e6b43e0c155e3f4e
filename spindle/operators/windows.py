"""Tumbling windows over a numeric clock (milliseconds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.scalars import duration_ms
from spindle.operators.ordered import Groups, ordered


def window_id(ts: Column, width_ms: int, origin: Column | float = 0.0) -> Column:
    """Number of the fixed-width window a time falls into."""
    return F.floor((ts - origin) / F.lit(float(width_ms))).cast("long")


def first_time(df: DataFrame, ts: str = "ts_record") -> DataFrame:
    """Smallest time of the whole trace, as one row."""
    return df.agg(F.min(ts).alias("start_ts"))


def split_windows(df: DataFrame, width: str | int, ts: str = "ts_record") -> DataFrame:
    """Add ``window_id`` counted from the first record, with the clock moved to start at 0."""
    start = F.broadcast(first_time(df, ts))  # one row
    moved = df.join(start).withColumn(ts, F.col(ts) - F.col("start_ts"))
    return moved.withColumn("window_id", window_id(F.col(ts), duration_ms(width))).drop("start_ts")


def split_window_sizes(df: DataFrame, widths: Sequence[str], ts: str = "ts_record") -> DataFrame:
    """One copy of the trace per window size, with ``window`` (text) and ``window_id``."""
    sizes = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(duration_ms(w)).alias("_ms")) for w in widths])
    copies = df.select("*", F.inline(sizes))
    return copies.withColumn("window_id", F.floor(F.col(ts) / F.col("_ms")).cast("long")).drop("_ms")


def relative_time(df: DataFrame, keys: Sequence[str], ts: str = "ts_record") -> DataFrame:
    """Shift the clock of every window so that it starts at 0."""
    starts = df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    return Groups.measure(df, keys).join(df, starts).withColumn(ts, F.col(ts) - F.col("_start")).drop("_start")


def window_validity(
    df: DataFrame, keys: Sequence[str], width_ms: int, ts: str = "ts_record", tolerance_s: float = 0.5, tail_tolerance_s: float = 0.1
) -> DataFrame:
    """Span of every window and whether it fills the window; the last window of a trace has its own tolerance."""
    spans = df.groupBy(*keys, "window_id").agg(
        F.count(F.lit(1)).alias("num_io"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")
    )
    gap = F.abs((F.col("end_ts") - F.col("start_ts")) / 1000.0 - width_ms / 1000.0)
    marked = ordered(spans, keys, ["window_id"]).shifted({"_next": lambda w: F.lead("window_id").over(w)}, after=1)
    return marked.frame().select(
        *keys,
        "window_id",
        "num_io",
        "start_ts",
        "end_ts",
        F.col("_next").isNull().alias("is_tail"),
        (gap <= F.when(F.col("_next").isNull(), tail_tolerance_s).otherwise(tolerance_s)).alias("is_valid"),
    )


def regroup_windows(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Join ``k`` short windows into one long one; groups that lack a short window are left out."""
    grouped = df.withColumn("group_id", F.floor(F.col("window_id") / k).cast("long"))
    short = grouped.select(*keys, "group_id", "window_id").distinct()
    complete = short.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    return Groups.measure(grouped, [*keys, "group_id"]).join(grouped, complete.drop("_n"), "left_semi")


def concatenate(df: DataFrame, part: str = "chunk") -> DataFrame:
    """Put the traces of several files on one clock: each starts where the one before it ended."""
    spans = df.groupBy(part).agg(
        F.min("ts_record").alias("_min"), F.max("ts_record").alias("_max"), F.max("ts_submit").alias("_submit")
    )
    chain = ordered(spans, [], [part]).shifted({"_prev": lambda w: F.lag(part).over(w)}, before=1)
    first = F.col("_prev").isNull()
    chain = chain.with_columns({"_length": F.col("_max") - F.when(first, F.col("_min")).otherwise(F.lit(0.0))})
    chain = chain.running({"_record": ("sum", F.col("_length")), "_submitted": ("sum", F.col("_submit"))}, exclusive=True)
    shifts = chain.frame().select(
        part,
        F.coalesce(F.col("_record"), -F.col("_min")).alias("_shift"),
        F.coalesce(F.col("_submitted"), F.lit(0.0)).alias("_shift_submit"),
    )
    moved = Groups.measure(df, [part]).join(df, shifts)
    return moved.withColumns(
        {"ts_record": F.col("ts_record") + F.col("_shift"), "ts_submit": F.col("ts_submit") + F.col("_shift_submit")}
    ).drop("_shift", "_shift_submit")


def reclock(df: DataFrame, step_ms: int = 60_000, window: str = "window_id", ts: str = "ts_record") -> DataFrame:
    """Window ``i`` is moved to start at ``i * step_ms``."""
    return df.withColumn(ts, F.col(ts) + F.col(window) * F.lit(float(step_ms)))


def window_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every window row next to the values of the window before it (``reference_*``)."""
    lags = {f"reference_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in ["window_id", *columns]}
    paired = ordered(df, keys, ["window_id"]).shifted(lags, before=1).frame()
    return paired.where(F.col("reference_window_id").isNotNull())


def jitter_duplicates(df: DataFrame, keys: Sequence[str], order: str, step_ms: float, ts: str = "ts_record") -> DataFrame:
    """Spread records that share a timestamp: the n-th is moved by ``(n - 1) * step_ms``."""
    ranked = ordered(df, [*keys, ts], [order]).numbered("_nth").frame()
    return ranked.withColumn(ts, F.col(ts) + (F.col("_nth") - 1) * F.lit(step_ms)).drop("_nth")


