"""Time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.scalars import duration_ms
from spindle.operators import windows
from spindle.operators.restarts import restarted_windows
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import HOUR_MS, REPLAYED, TRACE, with_views


@query(
    "tw1_tumbling_windows",
    with_views(TRACE)
    + f""" SELECT disk_id, CAST(floor((ts_record - t0) / {HOUR_MS}) AS BIGINT) AS window_id, count(*) AS n
  FROM trace, (SELECT min(ts_record) AS t0 FROM trace) GROUP BY ALL""",
)
def tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return windows.split_windows(fixtures.trace(spark, folder), "1h").groupBy("disk_id", "window_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tw2_window_validity",
    with_views(TRACE)
    + """ SELECT disk_id, window_id, count(*) AS num_io, min(ts_record) AS start_ts, max(ts_record) AS end_ts,
    window_id = max(window_id) OVER (PARTITION BY disk_id) AS is_tail,
    abs((max(ts_record) - min(ts_record)) / 1000 - 86400) <= CASE WHEN window_id = max(window_id) OVER (PARTITION BY disk_id) THEN 360 ELSE 1800 END AS is_valid
  FROM (SELECT disk_id, ts_record, CAST(floor(ts_record / 86400000) AS BIGINT) AS window_id FROM trace) GROUP BY disk_id, window_id""",
)
def validity(spark: SparkSession, folder: str) -> DataFrame:
    """One-day windows; the tolerances fit the sparse records."""
    rows = fixtures.trace(spark, folder).withColumn("window_id", windows.window_id(F.col("ts_record"), duration_ms("1d")))
    return windows.window_validity(rows, ["disk_id"], duration_ms("1d"), tolerance_s=1800, tail_tolerance_s=360)


@query(
    "tw2_restarted_windows",
    with_views(TRACE)
    + """, times AS (SELECT DISTINCT disk_id, CAST(round(ts_record * 10) AS BIGINT) AS t FROM trace),
  step AS (SELECT disk_id, 0 AS k, min(t) - 1 AS l, NULL::BIGINT AS s, true AS closed FROM times GROUP BY disk_id
    UNION ALL SELECT disk_id, k + 1, l2, greatest(s1, min(v.t)), abs(l2 - greatest(s1, min(v.t)) - 432000000) <= 18000000 FROM (
      SELECT disk_id, k, CASE WHEN closed THEN f ELSE s END AS s1, max(u.t) AS l2 FROM (
        SELECT disk_id, k, l, s, closed, min(t.t) AS f FROM step JOIN times t USING (disk_id) WHERE t.t > l GROUP BY ALL) a
      JOIN times u USING (disk_id) WHERE u.t >= f AND u.t < CASE WHEN f <= l + 432000000 THEN l + 1 ELSE f END + 432000000 GROUP BY ALL) b
    JOIN times v USING (disk_id) WHERE v.t >= l2 - 432000000 GROUP BY disk_id, k, l2, s1),
  w AS (SELECT disk_id, s, l, row_number() OVER (PARTITION BY disk_id ORDER BY k) - 1 AS window_id FROM step WHERE closed AND k > 0)
  SELECT disk_id, window_id, count(*) AS num_io, min(ts_record) AS start_ts, max(ts_record) AS end_ts, sum(size)::BIGINT AS bytes
  FROM trace JOIN w USING (disk_id) WHERE round(ts_record * 10) BETWEEN s AND l GROUP BY ALL""",
)
def restarted(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of half a day that start anew after gaps; the tolerance of half an hour fits the sparse records."""
    trace = fixtures.trace(spark, folder).select("disk_id", "ts_record", "size")  # all columns given go through the shuffles
    rows = restarted_windows(trace, ["disk_id"], duration_ms("12h"), tolerance_s=1800)
    return rows.groupBy("disk_id", "window_id").agg(
        F.count(F.lit(1)).alias("num_io"), F.min("ts_record").alias("start_ts"), F.max("ts_record").alias("end_ts"), F.sum("size").alias("bytes")
    )


@query(
    "tw3_regroup_windows",
    with_views(TRACE)
    + f""", s AS (SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS window_id, size FROM trace),
  g AS (SELECT disk_id, CAST(floor(window_id / 3) AS BIGINT) AS group_id FROM s GROUP BY ALL HAVING count(DISTINCT window_id) = 3)
  SELECT disk_id, group_id, count(*) AS n, sum(size)::BIGINT AS bytes
  FROM (SELECT *, CAST(floor(window_id / 3) AS BIGINT) AS group_id FROM s) SEMI JOIN g USING (disk_id, group_id) GROUP BY ALL""",
)
def regroup(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).withColumn("window_id", windows.window_id(F.col("ts_record"), HOUR_MS))
    grouped = windows.regroup_windows(rows, ["disk_id"], 3)
    return grouped.groupBy("disk_id", "group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    "tw4_concatenate",
    with_views(TRACE, REPLAYED)
    + """, f AS (SELECT chunk, min(ts_record) AS a, max(ts_record) AS z, max(ts_submit) AS s, row_number() OVER (ORDER BY chunk) AS i FROM replayed GROUP BY chunk),
  c AS (SELECT f.chunk, CASE WHEN f.i = 1 THEN -f.a ELSE
      (SELECT sum(CASE WHEN p.i = 1 THEN p.z - p.a ELSE p.z END) FROM f p WHERE p.i < f.i) END AS shift,
    coalesce((SELECT sum(p.s) FROM f p WHERE p.i < f.i), 0) AS shift_submit FROM f)
  SELECT event_id, round(ts_record + shift, 4) AS ts_record, round(ts_submit + shift_submit, 4) AS ts_submit FROM replayed JOIN c USING (chunk)""",
)
def concatenate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(windows.concatenate(fixtures.replayed(spark, folder)).select("event_id", "ts_record", "ts_submit"), 4)


@query("tw5_reclock", with_views(TRACE, REPLAYED) + " SELECT event_id, round(ts_record + chunk * 60000, 6) AS ts_record FROM replayed")
def reclock(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(windows.reclock(fixtures.replayed(spark, folder), window="chunk").select("event_id", "ts_record"))


@query(
    "tw6_window_pairs",
    with_views(TRACE)
    + f""", c AS (SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS window_id, count(*) AS num_io FROM trace GROUP BY ALL)
  SELECT * FROM (SELECT *, lag(window_id) OVER w AS reference_window_id, lag(num_io) OVER w AS reference_num_io FROM c
    WINDOW w AS (PARTITION BY disk_id ORDER BY window_id)) WHERE reference_window_id IS NOT NULL""",
)
def pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).groupBy("disk_id", windows.window_id(F.col("ts_record"), HOUR_MS).alias("window_id"))
    return windows.window_pairs(rows.agg(F.count(F.lit(1)).alias("num_io")), ["disk_id"], ["num_io"])


@query(
    "tw7_window_sizes",
    with_views(TRACE)
    + """ SELECT "window", CAST(floor(ts_record / ms) AS BIGINT) AS window_id, count(*) AS n, sum(size)::BIGINT AS bytes
  FROM trace, (VALUES ('1m', 60000), ('1h', 3600000), ('12h', 43200000), ('1d', 86400000)) s("window", ms) GROUP BY ALL""",
)
def sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.split_window_sizes(fixtures.trace(spark, folder), ["1m", "1h", "12h", "1d"])
    return rows.groupBy("window", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    "tw8_duration_windows",
    with_views(TRACE) + " SELECT CAST(floor(ts_record / 7200000) AS BIGINT) AS window_id, count(*) AS n FROM trace GROUP BY ALL",
)
def duration_windows(spark: SparkSession, folder: str) -> DataFrame:
    window = windows.window_id(F.col("ts_record"), duration_ms("2hours")).alias("window_id")
    return fixtures.trace(spark, folder).groupBy(window).agg(F.count(F.lit(1)).alias("n"))


@query("so1_sort_in_windows", with_views(TRACE) + f" SELECT event_id, row_number() OVER (PARTITION BY floor(ts_record / {HOUR_MS}) ORDER BY ts_record, event_id) AS position FROM trace")
def sort_in_windows(spark: SparkSession, folder: str) -> DataFrame:
    from spindle.operators.ordered import ordered

    rows = fixtures.trace(spark, folder).withColumn("window_id", windows.window_id(F.col("ts_record"), HOUR_MS))
    return ordered(rows, ["window_id"], ["ts_record", "event_id"]).numbered("position").frame().select("event_id", "position")


@query(
    "so5_order_by_duration",
    """SELECT d AS "window", minutes, row_number() OVER (ORDER BY minutes, d) AS position, n FROM (
    SELECT (k || unit) AS d, k * CASE unit WHEN 'm' THEN 1 WHEN 'h' THEN 60 ELSE 1440 END AS minutes, count(*) AS n
    FROM (SELECT user_id % 7 + 1 AS k, ['m', 'h', 'd'][CAST(event_id % 3 + 1 AS INTEGER)] AS unit FROM events) GROUP BY ALL)""",
)
def order_by_duration(spark: SparkSession, folder: str) -> DataFrame:
    from spindle.functions.scalars import duration_minutes_column
    from spindle.operators.ordered import ordered

    unit = F.element_at(F.array(F.lit("m"), F.lit("h"), F.lit("d")), (F.col("event_id") % 3 + 1).cast("int"))
    texts = fixtures.table(spark, folder, "events").groupBy(F.concat(F.col("user_id") % 7 + 1, unit).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    timed = texts.withColumn("minutes", duration_minutes_column(F.col("window")))
    return ordered(timed, [], ["minutes", "window"]).numbered("position").frame().orderBy("position")
