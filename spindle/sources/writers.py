"""Writers. Windows are partitions of one table, never a file per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_device(df: DataFrame, path: str, device: int, column: str = "disk_id") -> None:
    """Records of one device as Parquet."""
    df.where(F.col(column) == device).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def write_windows(
    df: DataFrame,
    path: str,
    device: str = "disk_id",
    window: str = "window_id",
    order: str = "ts_record",
    windows_per_folder: int = 1440,
    rows_per_file: int = 5_000_000,
) -> None:
    """Time-ordered files below one folder per device and run of windows.

    Rows are range-partitioned by device, window and time, so a large window is spread over several tasks and files.
    Within a file the rows are sorted, so a filter on the window skips all row groups but its own; a folder per
    window would leave millions of tiny files.
    """
    by = [device, window, order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    grouped = ranged.withColumn("windows", F.floor(F.col(window) / windows_per_folder))
    grouped.write.mode("overwrite").partitionBy(device, "windows").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_characteristics(df: DataFrame, path: str, digits: int = 4) -> None:
    """Flat CSV with rounded decimals."""
    rounded = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    write_csv(df.select(*rounded), path)


def replay_form(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The five columns a replayer reads: time from the window's start, a dummy device, offset, size, type."""
    from spindle.operators.windows import relative_time

    return relative_time(df, keys).withColumn("dummy", F.lit(0)).select(*keys, "ts_record", "dummy", "offset", "size", "io_type")


def write_replay(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    ordered = replay_form(df, keys).repartitionByRange(*keys, "ts_record").sortWithinPartitions(*keys, "ts_record")
    ordered.write.mode("overwrite").partitionBy(*keys).option("sep", " ").csv(path)


def write_stat_series(df: DataFrame, path: str) -> None:
    """One long table of series, partitioned by what it holds."""
    df.write.mode("overwrite").partitionBy("stat", "variant", "metric").parquet(path)


def write_drifts(drifts: DataFrame, slices: DataFrame, path: str) -> None:
    """The drift list, and the rows of every drift below its type."""
    drifts.write.mode("overwrite").option("header", True).csv(f"{path}/list")
    slices.write.mode("overwrite").partitionBy("type").parquet(f"{path}/data")


def write_features(df: DataFrame, path: str) -> None:
    """One feature table; all or reads only, raw or filtered, are filters on its two partition columns."""
    df.write.mode("overwrite").partitionBy("is_outlier", "io_type").parquet(path)
