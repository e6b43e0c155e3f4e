"""Writing, checked by reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import distribution, drift, features, label
from spindle.operators.characteristic import characteristic
from spindle.operators.windows import split_windows
from spindle.plans.drifts import SETTINGS, DRIFT_SQL
from spindle.plans.labels import _FEATURES, _OUTLIERS, _PERIODS, KNEES_SQL
from spindle.plans.registry import query, rounded
from spindle.session import scratch_path
from spindle.sources import fixtures, writers
from spindle.sources.fixtures import REPLAYED, TRACE, with_views


@query("snk1_device_parquet", with_views(TRACE) + ' SELECT event_id, ts_record, disk_id, "offset", size, io_type FROM trace WHERE disk_id = 3')
def device_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "device")
    writers.write_device(fixtures.trace(spark, folder), path, 3)
    return spark.read.parquet(path)


@query("snk2_count_csv", with_views(TRACE) + " SELECT disk_id, count(*) AS n FROM trace GROUP BY 1")
def count_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    writers.write_csv(fixtures.trace(spark, folder).groupBy("disk_id").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("disk_id bigint, n bigint").option("header", True).csv(path)


@query(
    "snk3_window_files",
    with_views(TRACE)
    + """ SELECT disk_id, window_id, count(*) AS n, min(ts_record) AS first_ts, max(ts_record) AS last_ts FROM (
    SELECT disk_id, event_id, CAST(floor(ts_record / 3600000) AS BIGINT) AS window_id, ts_record FROM
      (SELECT * EXCLUDE (ts_record), ts_record - min(ts_record) OVER () AS ts_record FROM trace)) GROUP BY ALL""",
)
def window_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "windows")
    writers.write_windows(split_windows(fixtures.trace(spark, folder), "1h"), path, windows_per_folder=24)
    back = spark.read.schema("ts_record double, disk_id bigint, window_id bigint").parquet(path)
    return back.groupBy("disk_id", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_record").alias("first_ts"), F.max("ts_record").alias("last_ts")
    )


@query(
    "snk4_characteristic_csv",
    with_views(TRACE)
    + """ SELECT disk_id, count(*) AS num_io, round(avg(size), 4) AS size_avg, round(quantile_cont(size, 0.99), 4) AS size_p99,
    round(stddev_pop(size), 4) AS size_std FROM trace GROUP BY 1""",
)
def characteristic_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "characteristic")
    writers.write_characteristics(characteristic(fixtures.trace(spark, folder), ["disk_id"]), path)
    back = spark.read.option("header", True).csv(path)
    doubles = ["size_avg", "size_p99", "size_std"]
    return back.select(
        F.col("disk_id").cast("long").alias("disk_id"), F.col("num_io").cast("long").alias("num_io"), *[F.col(c).cast("double").alias(c) for c in doubles]
    )


@query(
    "snk5_replay_files",
    with_views(TRACE, REPLAYED)
    + """ SELECT chunk, round(ts_record - min(ts_record) OVER (PARTITION BY chunk), 6) AS ts_record, 0 AS dummy, "offset", size, io_type
  FROM replayed""",
)
def replay_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "replay")
    writers.write_replay(fixtures.replayed(spark, folder), path, ["chunk"])
    schema = "ts_record double, dummy int, offset bigint, size bigint, io_type int, chunk bigint"
    return rounded(spark.read.schema(schema).option("sep", " ").csv(path))


@query(
    "snk6_stat_series",
    with_views(TRACE, REPLAYED)
    + """, w AS (SELECT CAST(floor(ts_record / 3600000) AS BIGINT) AS hour, count(*)::DOUBLE AS num_io, avg(size)::DOUBLE AS size_avg, max(latency)::DOUBLE AS latency_max FROM replayed GROUP BY 1),
  l AS (SELECT hour, metric, value FROM w UNPIVOT (value FOR metric IN (num_io, size_avg, latency_max))),
  v AS (SELECT *, value / avg(value) OVER (PARTITION BY metric) AS norm FROM l),
  d AS (SELECT metric, hour, value AS real, norm, coalesce(value / nullif(lag(value) OVER o, 0), 0) AS diff, coalesce(norm / nullif(lag(norm) OVER o, 0), 0) AS diff_norm
    FROM v WINDOW o AS (PARTITION BY metric ORDER BY hour)),
  r AS (SELECT metric, variant, hour, round(y, 9) AS y FROM d UNPIVOT (y FOR variant IN (real, norm, diff, diff_norm))),
  s AS (SELECT metric, variant, count(*) AS n, 1.06::DOUBLE * stddev_samp(y) * pow(count(*), -0.2::DOUBLE) AS h FROM r GROUP BY ALL),
  k AS (SELECT metric, variant, p.y AS x, (p.y - r.y) / h / sqrt(2) AS u, n, h FROM (SELECT DISTINCT metric, variant, y FROM r) p JOIN r USING (metric, variant) JOIN s USING (metric, variant) WHERE h > 0),
  f AS (SELECT metric, variant, x, sum(0.5::DOUBLE * exp(-abs(u)) * sin(abs(u) + pi() / 4)) / any_value(n) / any_value(h) AS pdf,
    avg(CASE WHEN u >= 0 THEN 1 - 0.5::DOUBLE * exp(-u) * cos(u) ELSE 0.5::DOUBLE * exp(u) * cos(u) END) AS cdf FROM k GROUP BY ALL)
  SELECT metric, variant, stat, round(x, 6) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM (
    SELECT metric, variant, 'raw' AS stat, hour::DOUBLE AS x, y FROM r UNION ALL SELECT metric, variant, 'pdf', x, pdf FROM f UNION ALL SELECT metric, variant, 'cdf_from_pdf', x, cdf FROM f
    UNION ALL SELECT metric, variant, 'cdf', y, sum(count(*)) OVER (PARTITION BY metric, variant ORDER BY y) / sum(count(*)) OVER (PARTITION BY metric, variant) FROM r GROUP BY metric, variant, y)""",
)
def stat_series(spark: SparkSession, folder: str) -> DataFrame:
    """Four statistics of four variants of every metric, written below their names and read back."""
    hour = F.floor(F.col("ts_record") / 3_600_000).alias("hour")
    totals = {"num_io": F.count(F.lit(1)), "size_avg": F.avg("size"), "latency_max": F.max("latency")}
    rows = fixtures.replayed(spark, folder).groupBy(hour).agg(*[c.alias(n) for n, c in totals.items()])
    path = scratch_path(spark, "stats")
    writers.write_stat_series(distribution.stat_series(rows, [], "hour", list(totals)), path)
    back = spark.read.schema("x double, y double, stat string, variant string, metric string").parquet(path)
    return rounded(back, {"x": 6, "y": 5}).withColumns({c: F.col(c) + F.lit(0.0) for c in ("x", "y")})  # no -0.0


@query(
    "snk7_drift_files",
    DRIFT_SQL + """ SELECT type, start, "end", count(*) AS rows, sum(value) AS total FROM drifts d JOIN series s ON s.idx >= d.start AND s.idx < d."end" GROUP BY ALL""",
)
def drift_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = drift.index_series(fixtures.series(spark, folder), "hour")
    found = drift.find_drifts(rows, SETTINGS)
    path = scratch_path(spark, "drifts")
    writers.write_drifts(drift.selected_drifts(found), drift.slice_drifts(rows, found), path)
    back = spark.read.schema("series string, idx bigint, value double, start bigint, `end` bigint, type string").parquet(f"{path}/data")
    return back.groupBy("type", "start", "end").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


@query(
    "snk8_feature_variants",
    with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS, _OUTLIERS, _FEATURES)
    + """ SELECT CASE WHEN outlier <> 0 THEN 1 ELSE 0 END AS is_outlier, io_type, count(*) AS n, sum(reject)::BIGINT AS rejects
  FROM features JOIN outliers USING (event_id) GROUP BY ALL""",
)
def feature_variants(spark: SparkSession, folder: str) -> DataFrame:
    trace = fixtures.replayed(spark, folder)
    marked = label.label_with_outliers(trace, ["disk_id", "chunk"], ["ts_submit", "event_id"])
    made = features.feature_set(marked, ["disk_id"], "chunk", ["ts_submit", "event_id"], trace=trace)
    path = scratch_path(spark, "features")
    writers.write_features(made.withColumn("is_outlier", (F.col("outlier") != 0).cast("int")), path)
    back = spark.read.parquet(path)
    return back.groupBy("is_outlier", "io_type").agg(F.count(F.lit(1)).alias("n"), F.sum("reject").alias("rejects"))
