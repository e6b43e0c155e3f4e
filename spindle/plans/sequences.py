"""Lags, leads, rolling values, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import sequence
from spindle.operators.characteristic import with_interarrival
from spindle.operators.ordered import ordered
from spindle.operators.windows import jitter_duplicates
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import REPLAYED, TRACE, with_views

_DEVICE = "WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id)"


@query(
    "wf1_interarrival",
    with_views(TRACE)
    + """ SELECT event_id, round(ts_record - lag(ts_record) OVER w, 6) AS iat,
    round(CASE WHEN io_type = 1 THEN ts_record - lag(ts_record) OVER t END, 6) AS read_iat,
    round(CASE WHEN io_type = 0 THEN ts_record - lag(ts_record) OVER t END, 6) AS write_iat FROM trace
  WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id), t AS (PARTITION BY disk_id, io_type ORDER BY ts_record, event_id)""",
)
def interarrival(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(with_interarrival(fixtures.trace(spark, folder), ["disk_id"], "event_id").select("event_id", "iat", "read_iat", "write_iat"))


@query(
    "wf2_history",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, coalesce(lag(latency, 1) OVER w, 0) AS hist_0_latency, coalesce(lag(latency, 2) OVER w, 0) AS hist_1_latency,
    coalesce(lag(latency, 3) OVER w, 0) AS hist_2_latency FROM replayed """
    + _DEVICE,
)
def history(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordered(fixtures.replayed(spark, folder), ["disk_id"], ["ts_record", "event_id"])
    return sequence.with_history(rows, "latency", 3).frame().select("event_id", *[f"hist_{i}_latency" for i in range(3)])


@query(
    "wf3_future",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, latency AS future_0_latency, coalesce(lead(latency, 1) OVER w, 0) AS future_1_latency,
    coalesce(lead(latency, 2) OVER w, 0) AS future_2_latency FROM replayed """
    + _DEVICE,
)
def future(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordered(fixtures.replayed(spark, folder), ["disk_id"], ["ts_record", "event_id"])
    return sequence.with_future(rows, "latency", 3).frame().select("event_id", *[f"future_{i}_latency" for i in range(3)])


@query(
    "wf5_queue_length",
    with_views(TRACE, REPLAYED)
    + """ SELECT a.event_id, count(*) AS queue_len FROM replayed a JOIN replayed b
    ON a.disk_id = b.disk_id AND a.chunk = b.chunk AND a.ts_submit = b.ts_submit AND b.event_id <= a.event_id GROUP BY 1""",
)
def queue_length(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.queue_length(fixtures.replayed(spark, folder), ["disk_id", "chunk"], "event_id").select("event_id", "queue_len")


@query(
    "wf7_rolling_mean",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, round(avg(latency) OVER (PARTITION BY disk_id ORDER BY ts_record, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6)
    AS rolling_latency FROM replayed""",
)
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordered(fixtures.replayed(spark, folder), ["disk_id"], ["ts_record", "event_id"])
    return rounded(sequence.rolling_mean(rows, ["latency"], 10).frame().select("event_id", "rolling_latency"))


@query(
    "wf16_islands",
    with_views(TRACE)
    + """, t AS (SELECT *, CASE WHEN io_type = lag(io_type) OVER w THEN 0 ELSE 1 END AS turn FROM trace WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id)),
  i AS (SELECT *, CAST(sum(turn) OVER w AS BIGINT) AS island FROM t WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id))
  SELECT event_id, island, count(*) OVER (PARTITION BY disk_id, island) AS island_size FROM i""",
)
def islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordered(fixtures.trace(spark, folder), ["disk_id"], ["ts_record", "event_id"])
    return sequence.islands(rows, "io_type").frame().select("event_id", "island", "island_size")


@query(
    "jn8_rows_of_small_islands",
    with_views(TRACE)
    + """, t AS (SELECT *, CASE WHEN io_type = lag(io_type) OVER w THEN 0 ELSE 1 END AS turn FROM trace WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id)),
  i AS (SELECT *, sum(turn) OVER w AS island FROM t WINDOW w AS (PARTITION BY disk_id ORDER BY ts_record, event_id)),
  s AS (SELECT disk_id, island FROM i WHERE io_type = 0 GROUP BY ALL HAVING count(*) <= 3)
  SELECT event_id FROM i SEMI JOIN s USING (disk_id, island) WHERE io_type = 0""",
)
def rows_of_small_islands(spark: SparkSession, folder: str) -> DataFrame:
    flagged = fixtures.trace(spark, folder).withColumn("flag", 1 - F.col("io_type"))
    rows = sequence.in_long_run(ordered(flagged, ["disk_id"], ["ts_record", "event_id"]), "flag", 3, "is_long").frame()
    return rows.where((F.col("flag") == 1) & ~F.col("is_long")).select("event_id")


@query(
    "wf17_jitter_duplicates",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, round(ts_submit + (row_number() OVER (PARTITION BY disk_id, ts_submit ORDER BY event_id) - 1) * 0.5, 6) AS ts_submit FROM replayed""",
)
def jitter(spark: SparkSession, folder: str) -> DataFrame:
    rows = jitter_duplicates(fixtures.replayed(spark, folder), ["disk_id"], "event_id", 0.5, ts="ts_submit")
    return rounded(rows.select("event_id", "ts_submit"))


@query(
    "ag15_per_tick_aggregates",
    with_views(TRACE, REPLAYED)
    + """, g AS (SELECT disk_id, ts_submit, count(*) AS n, count(*) FILTER (WHERE io_type = 1) AS r, count(*) FILTER (WHERE io_type = 0) AS w
    FROM replayed GROUP BY ALL),
  p AS (SELECT disk_id, ts_submit, lag(n) OVER k AS pn, lag(r) OVER k AS pr, lag(w) OVER k AS pw FROM g WINDOW k AS (PARTITION BY disk_id ORDER BY ts_submit)),
  v AS (SELECT disk_id, ts_submit, pn / 1e-3 AS iops, CASE WHEN pr = 0 THEN 1e-3 ELSE pr END AS num_read, CASE WHEN pw = 0 THEN 1e-3 ELSE pw END AS num_write
    FROM p WHERE pn IS NOT NULL),
  m AS (SELECT disk_id, ts_submit, avg(iops) OVER k AS iops, avg(num_read) OVER k AS num_read, avg(num_write) OVER k AS num_write,
    avg(num_read / num_write) OVER k AS rw_ratio FROM v WINDOW k AS (PARTITION BY disk_id ORDER BY ts_submit ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(coalesce(iops, 0), 7) AS iops, round(coalesce(num_read, 0), 7) AS num_read, round(coalesce(num_write, 0), 7) AS num_write,
    round(coalesce(rw_ratio, 0), 7) AS rw_ratio FROM replayed LEFT JOIN m USING (disk_id, ts_submit)""",
)
def per_tick(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.per_tick_aggregates(fixtures.replayed(spark, folder), ["disk_id"], "ts_submit")
    return rounded(rows.select("event_id", "iops", "num_read", "num_write", "rw_ratio"), 7)
