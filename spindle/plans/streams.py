"""Streaming forms, run to the end over rows that arrive in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from spindle.operators import drift
from spindle.plans.registry import query
from spindle.session import scratch_path
from spindle.sources import fixtures
from spindle.streaming import online


def arrive(rows: DataFrame, name: str, order: str, start: Callable[[DataFrame], StreamingQuery], parts: int = 4) -> str:
    """Write the rows part by part in ``order``; after each part a query started by ``start`` reads what is new. The folder."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    cuts = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    for i, (low, high) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")])):
        rows.where((F.col(order) > low) & (F.col(order) <= high)).write.parquet(f"{path}/{i}")
        start(spark.readStream.schema(rows.schema).parquet(f"{path}/*")).awaitTermination()
    return path


def drained(rows: DataFrame, name: str, order: str, plan: Callable[[DataFrame], DataFrame], closed_after: int | None = None) -> DataFrame:
    """What an append stream has put out once all parts have arrived.

    With ``closed_after``, a marker comes last: a row of nulls so far behind the newest row that the watermark passes the
    end of all that is open. Nothing follows the marker, so what it opens itself is never put out.
    """
    spark = rows.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    schema = []

    def start(stream: DataFrame) -> StreamingQuery:
        result = plan(stream)
        schema[:] = [result.schema]
        sink = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        return sink.outputMode("append").trigger(availableNow=True).start()

    path = arrive(rows, name, order, start)
    if closed_after is not None:
        marker = rows.agg(F.max(order).alias("newest")).where("newest is not null")
        values = [(F.col("newest") + closed_after if c.name == order else F.lit(None)).cast(c.dataType).alias(c.name) for c in rows.schema]
        marker.select(*values).write.parquet(f"{path}/marker")
        start(spark.readStream.schema(rows.schema).parquet(f"{path}/*")).awaitTermination()
    return spark.read.schema(schema[0]).parquet(out)


@query("str1_window_stream")
def window_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    return drained(rows, "windows", "ts_record", lambda s: online.window_characteristics(online.with_event_time(s), "1 hour"), fixtures.DAY_MS)


@query("str2_sliding_stream")
def sliding_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    return drained(rows, "sliding", "ts_record", lambda s: online.window_characteristics(online.with_event_time(s), "6 hours", "3 hours"), fixtures.DAY_MS)


@query("str3_sessions")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    return drained(rows, "sessions", "ts_record", lambda s: online.sessions(online.with_event_time(s), "30 minutes"), fixtures.DAY_MS)


@query("str4_online_concept_ends")
def online_concept_ends(spark: SparkSession, folder: str) -> DataFrame:
    rows = drift.index_series(fixtures.series(spark, folder), "hour")
    return drained(rows, "ends", "idx", lambda s: online.online_concept_ends(s, 4, 4, stability=5))


@query("str5_late_rows")
def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th record arrives two days late."""
    late_by = F.when(F.col("event_id") % 50 == 49, fixtures.DAY_MS * 2).otherwise(0)
    rows = fixtures.trace(spark, folder).withColumn("_arrival", F.col("ts_record") + late_by)
    on_time, late, marks, state = (scratch_path(spark, n) for n in ("on-time", "late", "late-marks", "late-state"))
    delay = fixtures.HOUR_MS
    arrive(rows, "late-in", "_arrival", lambda s: online.split_late(s.drop("_arrival"), fixtures.HOUR_MS, delay, on_time, late, marks, state), parts=8)
    sides = [spark.read.schema("ts_record double").parquet(p).withColumn("is_late", F.lit(x)) for p, x in ((on_time, False), (late, True))]
    return sides[0].unionByName(sides[1]).groupBy("is_late").agg(F.count(F.lit(1)).alias("n"))


@query("str6_scored_batches")
def scored_batches(spark: SparkSession, folder: str) -> DataFrame:
    out, state = scratch_path(spark, "scores"), scratch_path(spark, "scores-state")
    arrive(fixtures.prediction(spark, folder), "prediction-in", "row_id", lambda s: online.score_batches(s, out, state))
    return spark.read.parquet(out)
