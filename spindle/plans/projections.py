"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import scalars
from spindle.functions.predicates import contiguous_chunks, contains_any, matching, minutes, within_any
from spindle.operators.characteristic import characteristic, long_metrics
from spindle.operators.features import model_columns, readonly
from spindle.operators.selection import order_statistics
from spindle.operators.sequence import pages
from spindle.operators.windows import relative_time
from spindle.plans.labels import FEATURES_SQL, features_of
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import HOUR_MS, REPLAYED, TRACE, with_views


@query("prj1_pick_device", with_views(TRACE) + ' SELECT event_id, ts_record, "offset", size, io_type FROM trace WHERE disk_id = 5 ORDER BY ts_record')
def pick_device(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).where(F.col("disk_id") == 5).sort("ts_record", "event_id")
    return rows.drop("disk_id")


@query(
    "prj2_predicate_text",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, chunk, round(ts_record / 60000, 9) AS minute FROM replayed
  WHERE latency > 500 AND (io_type = 1 OR size >= 8192) AND chunk BETWEEN 2 AND 9""",
)
def predicate_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching(fixtures.replayed(spark, folder), "latency > 500 and (io_type = 1 or size >= 8192)")
    rows = rows.where(contiguous_chunks(F.col("chunk"), 2, 9))
    return rounded(rows.select("event_id", "chunk", minutes(F.col("ts_record")).alias("minute")), 9)


@query(
    "prj2_text_lists",
    """SELECT event_type, (event_type LIKE '%ie%' OR event_type LIKE '%rro%') AS contains_any,
    ('page_view' LIKE '%' || event_type || '%' OR 'clicks' LIKE '%' || event_type || '%') AS within_any, count(*) AS n FROM events GROUP BY ALL""",
)
def text_lists(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return fixtures.table(spark, folder, "events").groupBy(
        "event_type", contains_any(kind, ["ie", "rro"]).alias("contains_any"), within_any(kind, ["page_view", "clicks"]).alias("within_any")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj3_filter_characteristics",
    with_views(TRACE)
    + f""" SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS window_id, count(*) AS num_io,
    count(*) FILTER (WHERE io_type = 1) AS read_count, round(avg(size), 6) AS size_avg FROM trace GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE io_type = 1) > 1 AND avg(size) > 20000""",
)
def filter_characteristics(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).withColumn("window_id", F.floor(F.col("ts_record") / HOUR_MS))
    wide = matching(characteristic(rows, ["disk_id", "window_id"]), "read_count > 1 and size_avg > 20000")
    return rounded(wide.select("disk_id", "window_id", "num_io", "read_count", "size_avg"))


@query(
    "prj4_relative_time",
    with_views(TRACE, REPLAYED) + " SELECT event_id, round(ts_record - min(ts_record) OVER (PARTITION BY chunk), 6) AS ts_record FROM replayed",
)
def relative(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(relative_time(fixtures.replayed(spark, folder), ["chunk"]).select("event_id", "ts_record"))


@query("prj5_throughput", with_views(TRACE, REPLAYED) + " SELECT event_id, round_even(size / latency, 0) AS throughput FROM replayed")
def throughput(spark: SparkSession, folder: str) -> DataFrame:
    value = scalars.round_half_even(scalars.throughput(F.col("size"), F.col("latency")))
    return fixtures.replayed(spark, folder).select("event_id", value.alias("throughput"))


@query(
    "prj6_read_write_views",
    with_views(TRACE) + " SELECT io_type, count(*) AS n, sum(size)::BIGINT AS bytes FROM trace GROUP BY 1",
)
def read_write_views(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder)
    reads = readonly(rows).withColumn("io_type", F.lit(1))
    writes = rows.where(F.col("io_type") == 0)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")]
    return reads.groupBy("io_type").agg(*sums).unionByName(writes.groupBy("io_type").agg(*sums))


@query(
    "prj7_model_columns",
    FEATURES_SQL + """ SELECT * EXCLUDE (disk_id, chunk, io_type, latency, ts_submit) FROM features WHERE io_type = 1
  ORDER BY chunk DESC, ts_submit DESC, event_id DESC LIMIT 500""",
)
def newest_model_columns(spark: SparkSession, folder: str) -> DataFrame:
    return model_columns(features_of(spark, folder), ["event_id"], ["chunk", "ts_submit", "event_id"], last=500)


@query(
    "prj8_drop_infinite",
    with_views(TRACE, REPLAYED)
    + """ SELECT disk_id, round(quantile_cont(size / (latency - 1), 0.9), 6) AS p90, count(*) AS n FROM replayed
  WHERE latency > 1 GROUP BY 1""",
)
def drop_infinite(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    value = scalars.finite(scalars.throughput(F.col("size"), F.col("latency") - 1))
    kept = rows.withColumn("_v", value).where(F.col("_v").isNotNull())
    stats = order_statistics(kept, ["disk_id"], {"v": F.col("_v")}, [0.9]).select("disk_id", F.col("v_pct")[0].alias("p90"))
    return rounded(stats.join(kept.groupBy("disk_id").agg(F.count(F.lit(1)).alias("n")), "disk_id"))


@query(
    "prj9_comparison_units",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, round(size / 1e6, 9) AS size, round(latency / 1e3, 6) AS latency, round(size / 1e6 / (latency / 1e3) * 1000, 6) AS throughput
  FROM replayed WHERE latency / 1e3 <= 2.3""",
)
def comparison_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder).select("event_id", (F.col("size") / 1e6).alias("size"), (F.col("latency") / 1e3).alias("latency"))
    rows = rows.withColumn("throughput", F.col("size") / F.col("latency") * 1000).where(F.col("latency") <= 2.3)
    return rounded(rows, {"size": 9})


@query(
    "prj10_pages_and_completion",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, CAST(floor((size / 512 + 7) / 8) AS BIGINT) AS pages, CAST(floor(ts_submit * 1000) AS BIGINT) + latency AS complete_ts
  FROM replayed""",
)
def pages_and_completion(spark: SparkSession, folder: str) -> DataFrame:
    done = F.floor(F.col("ts_submit") * 1000).cast("long") + F.col("latency")
    return fixtures.replayed(spark, folder).select("event_id", pages(F.col("size")).alias("pages"), done.alias("complete_ts"))


@query(
    "prj11_wide_to_long",
    with_views(TRACE)
    + """ SELECT disk_id, metric, round(value, 6) AS value FROM (SELECT disk_id, avg(size) AS size_avg, quantile_cont(size, 0.5) AS size_median,
    CAST(count(*) AS DOUBLE) AS num_io FROM trace GROUP BY 1) UNPIVOT (value FOR metric IN (size_avg, size_median, num_io))""",
)
def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    wide = characteristic(fixtures.trace(spark, folder), ["disk_id"])
    return rounded(long_metrics(wide, ["disk_id"], ["size_avg", "size_median", "num_io"]))


@query(
    "fn_duration_text",
    """SELECT d, count(*) AS n, CAST(CASE unit WHEN 'm' THEN 1 WHEN 'min' THEN 1 WHEN 'h' THEN 60 WHEN 'hours' THEN 60 WHEN 'd' THEN 1440 ELSE 1 END * k AS BIGINT) AS minutes
  FROM (SELECT user_id % 9 + 1 AS k, ['m', 'min', 'h', 'hours', 'd', ''][CAST(event_id % 6 + 1 AS INTEGER)] AS unit, k || unit AS d FROM events) GROUP BY ALL""",
)
def duration_text(spark: SparkSession, folder: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("m", "min", "h", "hours", "d", "")])
    text = F.concat(F.col("user_id") % 9 + 1, F.element_at(units, (F.col("event_id") % 6 + 1).cast("int")))
    texts = fixtures.table(spark, folder, "events").groupBy(text.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return texts.withColumn("minutes", scalars.duration_minutes_column(F.col("d")))


@query(
    "fn_percent_text",
    with_views(TRACE)
    + """ SELECT disk_id, printf('%.2f', round(100.0 * count(*) FILTER (WHERE io_type = 1) / count(*), 2)) || '%' AS reads FROM trace GROUP BY 1""",
)
def percent_text(spark: SparkSession, folder: str) -> DataFrame:
    share = F.count_if(F.col("io_type") == 1) / F.count(F.lit(1))
    return fixtures.trace(spark, folder).groupBy("disk_id").agg(F.concat(F.format_string("%.2f", F.round(share * 100, 2)), F.lit("%")).alias("reads"))


@query(
    "fn_value_group",
    with_views(TRACE)
    + """ SELECT CASE WHEN v < 0 THEN 0 WHEN v - 1 <= 50 THEN 1 ELSE CAST(trunc((v - 50) / 25.0) AS INTEGER) + 2 END AS "group", count(*) AS n
  FROM (SELECT value - 20 AS v FROM trace) GROUP BY 1""",
)
def value_groups(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value") - 20
    rows = fixtures.table(spark, folder, "events").select(scalars.value_group(value, 25.0, 50.0).alias("group"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


