"""Trace-shaped views over the given ``events`` table, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
MINUTE_MS = 60_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, folder, "events").withColumn("ts_record", since / F.lit(1000.0))


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical trace: time in ms, device, byte offset and size, 1 = read."""
    return _events(spark, folder).select(
        "event_id",
        "ts_record",
        (F.col("user_id") % 8).alias("disk_id"),
        (F.col("event_id") * 4096).alias("offset"),
        ((F.floor("value") + 1) * 512).alias("size"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(0).alias("io_type"),
    )


TRACE = """trace AS (
  SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1000.0 AS ts_record,
    user_id % 8 AS disk_id, event_id * 4096 AS "offset", (CAST(floor(value) AS BIGINT) + 1) * 512 AS size,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS io_type, value
  FROM events)"""


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Trace with measured latency (us) and submit time; submit times repeat within a minute."""
    events = _events(spark, folder)
    return events.select(
        "event_id",
        "ts_record",
        (F.floor(F.col("value") * 10) + 50 * (F.col("event_id") % 7) + 1).alias("latency"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(0).alias("io_type"),
        ((F.floor("value") + 1) * 512).alias("size"),
        (F.col("event_id") * 4096).alias("offset"),
        (F.floor(F.col("ts_record") / MINUTE_MS) * F.lit(float(MINUTE_MS))).alias("ts_submit"),
        ((F.floor("value") + 1) * 512).alias("size_after_replay"),
        (F.col("user_id") % 8).alias("disk_id"),
        F.floor(F.col("ts_record") / DAY_MS).alias("chunk"),
    )


REPLAYED = f"""replayed AS (
  SELECT event_id, ts_record, CAST(floor(value * 10) AS BIGINT) + 50 * (event_id % 7) + 1 AS latency, io_type, size,
    "offset", floor(ts_record / {MINUTE_MS}) * {MINUTE_MS}.0 AS ts_submit, size AS size_after_replay, disk_id,
    CAST(floor(ts_record / {DAY_MS}) AS BIGINT) AS chunk
  FROM trace)"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    """I/O count per hour over all devices: the series drifts are searched in."""
    hours = _events(spark, folder).select(F.floor(F.col("ts_record") / HOUR_MS).alias("hour"))
    counts = hours.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit("num_io").alias("series"), F.col("hour").alias("hour"), F.col("n").cast("double").alias("value"))


def prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows of three models, one window per day."""
    probability = ((F.col("event_id") * 37) % 1000) / F.lit(1000.0)
    return _events(spark, folder).select(
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.floor(F.col("ts_record") / DAY_MS).alias("window_id"),
        F.col("event_id").alias("row_id"),
        F.when(F.col("value") > 60, 1).otherwise(0).alias("label"),
        F.when(probability > 0.5, 1).otherwise(0).alias("prediction"),
        probability.alias("probability"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(0).alias("io_type"),
    )


PREDICTION = f"""prediction AS (
  SELECT 'm' || (user_id % 3) AS model, CAST(floor(ts_record / {DAY_MS}) AS BIGINT) AS window_id, t.event_id AS row_id,
    CASE WHEN e.value > 60 THEN 1 ELSE 0 END AS label,
    CASE WHEN ((t.event_id * 37) % 1000) / 1000.0 > 0.5 THEN 1 ELSE 0 END AS prediction,
    ((t.event_id * 37) % 1000) / 1000.0 AS probability, io_type
  FROM trace t JOIN events e USING (event_id))"""

SERIES = f"""series AS (
  SELECT 'num_io' AS series, row_number() OVER (ORDER BY hour) - 1 AS idx, CAST(n AS DOUBLE) AS value
  FROM (SELECT floor(ts_record / {HOUR_MS}) AS hour, count(*) AS n FROM trace GROUP BY 1))"""


def with_views(*views: str) -> str:
    """A WITH clause from the view texts above, plus any further CTE texts."""
    return "WITH RECURSIVE " + ",\n".join(views)
