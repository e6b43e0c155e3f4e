"""Characteristics: one wide row of statistics per window, device or trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.scalars import ratio, throughput
from spindle.functions.stats import Extra, as_struct, statistics
from spindle.operators.ordered import Groups, ordered


def _sides(name: str, value: Column, split: bool = True) -> dict[str, Column]:
    if not split:
        return {name: value}
    is_read = F.col("io_type") == 1
    return {name: value, f"read_{name}": F.when(is_read, value), f"write_{name}": F.when(~is_read, value)}


def with_interarrival(df: DataFrame, keys: Sequence[str], order: str, groups: Groups | None = None) -> DataFrame:
    """Time since the previous record (``iat``), previous read (``read_iat``) and previous write (``write_iat``)."""
    ts, is_read = F.col("ts_record"), F.col("io_type") == 1
    last = {
        "_any": ("last", ts),
        "_read": ("last", F.when(is_read, ts)),
        "_write": ("last", F.when(~is_read, ts)),
    }
    rows = ordered(df, keys, ["ts_record", order], groups).running(last, exclusive=True).frame()
    gap = {k: F.when(F.col(k).isNotNull(), F.greatest(ts - F.col(k), F.lit(0.0))) for k in last}
    return rows.withColumns(
        {"iat": gap["_any"], "read_iat": F.when(is_read, gap["_read"]), "write_iat": F.when(~is_read, gap["_write"])}
    ).drop(*last)


def characteristic(
    df: DataFrame, keys: Sequence[str], order: str = "event_id", latency: bool | None = None, extra: dict[str, Extra] | None = None
) -> DataFrame:
    """Counts, span, ratios, rates and the statistics of every metric, all and per side, for each group.

    The group is shuffled once: inter-arrival times and the aggregates share the partitioning on ``keys``.
    """
    if latency is None:
        latency = "latency" in df.columns
    groups = Groups.measure(df, keys)
    rows = with_interarrival(df, keys, order, groups)
    metrics = {**_sides("size", F.col("size")), "offset": F.col("offset")}
    metrics |= {"iat": F.col("iat"), "read_iat": F.col("read_iat"), "write_iat": F.col("write_iat")}
    if latency:
        metrics |= _sides("latency", F.col("latency"))
        metrics |= _sides("throughput", throughput(F.col("size"), F.col("latency")))
    one = F.lit(1)
    counts = {
        "num_io": (F.count, one),
        "start_time": (F.min, F.col("ts_record")),
        "end_time": (F.max, F.col("ts_record")),
        "read_count": (F.count, F.when(F.col("io_type") == 1, one)),
        "write_count": (F.count, F.when(F.col("io_type") != 1, one)),
    }
    wide = statistics(rows, keys, metrics, counts | (extra or {}), groups)
    return with_rates(wide)


def with_rates(df: DataFrame) -> DataFrame:
    """Duration, ratios (0 where the divisor is 0), I/O rates per second and bandwidths in bytes per second."""
    df = df.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn("ts_unit", F.lit("ms"))
    seconds = F.col("duration") / 1000.0
    columns = {
        "read_ratio": ratio(F.col("read_count"), F.col("num_io")),
        "write_ratio": ratio(F.col("write_count"), F.col("num_io")),
        "rw_ratio": ratio(F.col("read_count"), F.col("write_count")),
    }
    for metric in ("size", "iat"):
        total, read, write = (F.col(f"{side}{metric}_sum") for side in ("", "read_", "write_"))
        columns[f"read_{metric}_ratio"] = ratio(read, total)
        columns[f"write_{metric}_ratio"] = ratio(write, total)
        columns[f"rw_{metric}_ratio"] = ratio(read, write)
    columns["iops"] = ratio(F.col("num_io"), seconds)
    columns["bandwidth"] = ratio(F.col("size_sum"), seconds)
    for side in ("read", "write"):
        columns[f"{side}_iops"] = ratio(F.col(f"{side}_count"), seconds)
        columns[f"{side}_bandwidth"] = ratio(F.col(f"{side}_size_sum"), seconds)
    return df.withColumns(columns)


def characteristic_with_overall(df: DataFrame, device: str, window: str = "window_id", order: str = "event_id") -> DataFrame:
    """Window rows and one overall row per device (null window), with accepted and rejected counts."""
    one = F.lit(1)
    labels = {"reject_count": (F.count, F.when(F.col("reject") == 1, one)), "accept_count": (F.count, F.when(F.col("reject") != 1, one))}
    per_window = characteristic(df, [device, window], order, extra=labels)
    overall = characteristic(df, [device], order, extra=labels)
    both = per_window.unionByName(overall.withColumn(window, F.lit(None).cast(per_window.schema[window].dataType)))
    return both.withColumns(
        {
            "reject_ratio": ratio(F.col("reject_count"), F.col("num_io")),
            "accept_ratio": ratio(F.col("accept_count"), F.col("num_io")),
        }
    )


def nested(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The flat row with each metric's statistics folded into one struct."""
    prefixes = tuple(f"{m}_" for m in metrics)
    scalars = [c for c in df.columns if c not in keys and not c.startswith(prefixes)]
    return df.select(*keys, *scalars, *[as_struct(m) for m in metrics])


def numeric_columns(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    kinds = ("double", "float", "bigint", "int", "smallint", "tinyint")
    return [name for name, kind in df.dtypes if kind in kinds and name not in ignore]


def normalise(df: DataFrame, columns: Sequence[str], by: str, keys: Sequence[str] = (), padding: float = 1.0) -> DataFrame:
    """Divide columns by their ``min``, ``avg`` or ``max`` over the group; a minimum of 0 or less gives 1."""
    aggregate = {"min": F.min, "avg": F.avg, "max": F.max}[by]
    # the aggregate has one row per key; the rows are not sorted or gathered for it
    base = df.groupBy(*keys).agg(*[aggregate(c).alias(f"_b_{c}") for c in columns])
    joined = Groups.measure(df, keys).join(df, base) if keys else df.join(F.broadcast(base))  # one row without keys
    out = {}
    for c in columns:
        divisor = F.col(f"_b_{c}") * F.lit(padding) if padding != 1.0 else F.col(f"_b_{c}")
        share = F.try_divide(F.col(c).cast("double"), divisor.cast("double"))
        out[c] = F.when(F.col(f"_b_{c}") > 0, share).otherwise(F.lit(1.0)) if by == "min" else share
    return joined.withColumns(out).drop(*[f"_b_{c}" for c in columns])


def long_metrics(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long: one row per key and column."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), name, value)


def multiplier_windows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], multipliers: Sequence[float], tolerance: float = 0.1, around: bool = False
) -> DataFrame:
    """Windows whose min-normalised metric lies in ``(m, m + tolerance]``, or within ``tolerance`` of ``m``; 1 is exact."""
    long = long_metrics(df, keys, columns)
    x, m = F.col("value"), F.col("multiplier")
    near = F.abs(x - m) <= tolerance if around else (x > m) & (x <= m + tolerance)
    fits = F.when(m == 1, x == 1).otherwise(near)
    table = F.explode(F.array(*[F.lit(float(v)) for v in (1, *multipliers)])).alias("multiplier")
    return long.select("*", table).where(fits)


def replay_summary(df: DataFrame) -> DataFrame:
    """Read share, duration, rates, mean latency and throughput per side of a replayed trace."""
    is_read = F.col("io_type") == 1
    seconds = F.max("ts_record") / 1000.0
    kib_per_s = (F.col("size") / 1024.0) / (F.col("latency") / 1_000_000.0)
    total = F.count(F.lit(1))
    return df.agg(
        F.floor(ratio(F.count_if(is_read), total) * 100).alias("read_percent"),
        F.round(seconds, 2).alias("duration_s"),
        total.alias("num_io"),
        F.count_if(is_read).alias("reads"),
        F.count_if(~is_read).alias("writes"),
        F.round(total / seconds, 2).alias("iops"),
        F.round(F.count_if(is_read) / seconds, 2).alias("read_iops"),
        F.round(F.count_if(~is_read) / seconds, 2).alias("write_iops"),
        F.round(F.avg(F.when(is_read, kib_per_s)) / 1000, 2).alias("read_throughput"),
        F.round(F.avg(F.when(~is_read, kib_per_s)) / 1000, 2).alias("write_throughput"),
        F.round(F.avg(F.when(is_read, F.col("latency"))), 2).alias("read_latency"),
        F.round(F.avg(F.when(~is_read, F.col("latency"))), 2).alias("write_latency"),
        F.round(F.max("ts_record") / total, 2).alias("interarrival"),
    )
