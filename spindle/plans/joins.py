"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.stats import iqr_bounds, statistics
from spindle.operators import joins as jn
from spindle.operators.characteristic import multiplier_windows, normalise
from spindle.plans.aggregates import _HOURLY, hourly
from spindle.plans.registry import query, rounded
from spindle.session import scratch_path
from spindle.sources import fixtures
from spindle.sources.fixtures import REPLAYED, TRACE, with_views


def named_windows(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("disk_id"), F.lit("_w"), F.col("window_id")).alias("name")
    return hourly(spark, folder).select(name, "num_io", "size_avg", "size_p90")


NAMED = f"{_HOURLY},\nnamed AS (SELECT 'd' || disk_id || '_w' || window_id AS name, num_io, size_avg, size_p90 FROM hourly)"
_MULTIPLIERS = (1.2, 1.5, 2, 2.4, 2.8, 3.5, 4, 5, 6, 7, 8, 9, 10)
_VALUES = ", ".join(f"({float(m)}::DOUBLE)" for m in (1, *_MULTIPLIERS))


def buckets_sql(around: bool = False) -> str:
    test = "abs(value - multiplier) <= 0.1::DOUBLE" if around else "value > multiplier AND value <= multiplier + 0.1::DOUBLE"
    return f"""{NAMED},
norm AS (SELECT name, CAST(num_io AS DOUBLE) / CAST(min(num_io) OVER () AS DOUBLE) AS num_io, size_avg / min(size_avg) OVER () AS size_avg FROM named),
bucket AS (SELECT name, metric, value, multiplier FROM (SELECT * FROM norm UNPIVOT (value FOR metric IN (num_io, size_avg))), (VALUES {_VALUES}) t(multiplier)
  WHERE CASE WHEN multiplier = 1 THEN value = 1 ELSE {test} END)"""


def buckets(spark: SparkSession, folder: str, around: bool = False) -> DataFrame:
    norm = normalise(named_windows(spark, folder).drop("size_p90"), ["num_io", "size_avg"], "min")
    return multiplier_windows(norm, ["name"], ["num_io", "size_avg"], _MULTIPLIERS, around=around)


@query("ag19_multiplier_buckets", with_views(TRACE, buckets_sql()) + " SELECT name, metric, multiplier, round(value, 6) AS value FROM bucket")
def multiplier_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(buckets(spark, folder))


@query("ag19_multipliers_around", with_views(TRACE, buckets_sql(True)) + " SELECT name, metric, multiplier, round(value, 6) AS value FROM bucket")
def multipliers_around(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(buckets(spark, folder, around=True))


@query(
    "jn1_listed_windows",
    with_views(TRACE, NAMED)
    + """ SELECT name, 'g' || (window_id % 5) AS "group", 'k' || window_id AS key, h.num_io, round(h.size_avg, 6) AS size_avg
  FROM hourly h JOIN named ON named.name = 'd' || disk_id || '_w' || window_id WHERE disk_id = window_id % 8""",
)
def listed_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = hourly(spark, folder).where(F.col("disk_id") == F.col("window_id") % 8)
    listed = rows.select(
        F.concat(F.lit("g"), F.col("window_id") % 5).alias("group"),
        F.concat(F.lit("k"), F.col("window_id")).alias("key"),
        F.concat(F.lit("d"), F.col("disk_id"), F.lit("_w"), F.col("window_id")).alias("name"),
    )
    return rounded(jn.select_listed(named_windows(spark, folder).drop("size_p90"), listed))


@query(
    "jn2_lookup",
    with_views(TRACE, REPLAYED)
    + """, v AS (SELECT disk_id, ts_submit, count(*) AS n, max(latency) AS worst FROM replayed WHERE io_type = 0 GROUP BY ALL)
  SELECT event_id, coalesce(n, 0) AS n, coalesce(worst, 0) AS worst FROM replayed LEFT JOIN v USING (disk_id, ts_submit)""",
)
def lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    values = rows.where(F.col("io_type") == 0).groupBy("disk_id", "ts_submit").agg(F.count(F.lit(1)).alias("n"), F.max("latency").alias("worst"))
    return jn.lookup(rows, values, ["disk_id", "ts_submit"], ["n", "worst"]).select("event_id", "n", "worst")


_FENCED = """fenced AS (SELECT 'g' || (event_id % 12) AS "group", avg(size) AS avg, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3
    FROM trace WHERE size < 2048 * (event_id % 12 + 1) AND size > 600 * (event_id % 12) GROUP BY 1),
grp AS (SELECT "group", avg, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, row_number() OVER (ORDER BY "group") AS pick FROM fenced)"""


@query(
    "jn7_nearest_group",
    with_views(TRACE, _FENCED)
    + """, fit AS (SELECT event_id, "group" FROM trace JOIN grp ON size BETWEEN lower AND upper QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(avg - size), "group") = 1)
  SELECT event_id, coalesce(fit."group", grp."group") AS "group", fit."group" IS NOT NULL AS in_interval FROM trace LEFT JOIN fit USING (event_id)
    JOIN grp ON grp.pick = size % (SELECT count(*) FROM grp) + 1""",
)
def nearest_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder)
    k = F.col("event_id") % 12
    members = rows.where((F.col("size") < 2048 * (k + 1)) & (F.col("size") > 600 * k)).withColumn("group", F.concat(F.lit("g"), k))
    wide = iqr_bounds(statistics(members, ["group"], {"size": F.col("size")}), "size")
    groups = wide.select(
        "group", F.col("size_avg").alias("avg"), F.col("size_lower_iqr_bound").alias("lower"), F.col("size_upper_iqr_bound").alias("upper")
    )
    return jn.choose_group(rows, groups).select("event_id", "group", "in_interval")


@query(
    "jn9_base_and_multiples",
    with_views(TRACE, buckets_sql())
    + """ SELECT b.name, b.metric, b.multiplier, round(b.value, 6) AS value, base.name AS base_name, round(base.value, 6) AS base_value
  FROM bucket b JOIN (SELECT metric, min(name) AS name, 1::DOUBLE AS value FROM bucket WHERE multiplier = 1 GROUP BY 1) base USING (metric) WHERE b.multiplier <> 1""",
)
def base_and_multiples(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(jn.multiplier_pairs(buckets(spark, folder), ["value"]))


@query(
    "jn10_positional",
    with_views(TRACE, NAMED)
    + """, a AS (SELECT name, num_io, row_number() OVER (ORDER BY num_io, name) AS position FROM named),
  b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier) SELECT * FROM a JOIN b USING (position)""",
)
def positional(spark: SparkSession, folder: str) -> DataFrame:
    left = named_windows(spark, folder).select("name", "num_io")
    right = fixtures.table(spark, folder, "supplier").select("s_suppkey")
    return jn.positional(left, ["num_io", "name"], right, ["s_suppkey"])


@query(
    "st1_union_of_files",
    with_views(TRACE, REPLAYED) + " SELECT chunk, event_id, latency FROM replayed",
)
def union_of_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder).select("chunk", "event_id", "latency")
    path = scratch_path(spark, "parts")
    rows.withColumn("part", F.col("chunk") % 4).write.partitionBy("part").parquet(path)
    out = None
    for part in range(4):
        read = spark.read.parquet(f"{path}/part={part}")
        out = read if out is None else out.unionByName(read)
    return out


@query(
    "st2_set_operations",
    """SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT l_suppkey FROM lineitem)
  UNION ALL SELECT 'left', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT l_suppkey FROM lineitem)""",
)
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    a = fixtures.table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    b = fixtures.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"))
    both = a.intersectAll(b).withColumn("side", F.lit("both"))
    return both.unionByName(a.exceptAll(b).withColumn("side", F.lit("left")))


@query(
    "jn6_leaf_overlap",
    with_views(TRACE)
    + """, l AS (SELECT event_id % 3 AS tree, size // 1024 AS leaf, 'm' || (disk_id % 3) AS model, io_type FROM trace),
  c AS (SELECT tree, leaf, model, count(*) AS n FROM l WHERE io_type = 1 GROUP BY ALL),
  s AS (SELECT tree, leaf, count(*) AS k FROM l WHERE io_type = 0 GROUP BY ALL)
  SELECT model, CAST(sum(n * k) AS BIGINT) AS overlap FROM c JOIN s USING (tree, leaf) GROUP BY 1""",
)
def leaf_overlap(spark: SparkSession, folder: str) -> DataFrame:
    leaves = fixtures.trace(spark, folder).select(
        (F.col("event_id") % 3).alias("tree"), F.floor(F.col("size") / 1024).alias("leaf"), F.concat(F.lit("m"), F.col("disk_id") % 3).alias("model"), "io_type"
    )
    counts = leaves.where(F.col("io_type") == 1).groupBy("tree", "leaf", "model").agg(F.count(F.lit(1)).alias("count"))
    return jn.leaf_overlap(leaves.where(F.col("io_type") == 0), counts)


