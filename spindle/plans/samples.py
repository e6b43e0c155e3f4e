"""Samples and schedules (hash-ranked, so SQL draws the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import sampling as sm
from spindle.plans.joins import buckets, buckets_sql
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import PREDICTION, REPLAYED, TRACE, with_views


def draw_sql(seed: int, *ids: str) -> str:
    text = " || '-' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) % 1000000)"


@query("sm1_thinned", with_views(TRACE) + f" SELECT event_id, disk_id, io_type FROM trace WHERE {draw_sql(42, 'event_id')} < 300000")
def thinned(spark: SparkSession, folder: str) -> DataFrame:
    return sm.rescale(fixtures.trace(spark, folder), 0.3, ["event_id"]).select("event_id", "disk_id", "io_type")


@query(
    "sm2_thickened",
    with_views(TRACE)
    + f""" SELECT event_id, CAST(copy AS INTEGER) AS copy, round(ts_record + copy * 0.01, 3) AS ts_record FROM (
    SELECT event_id, ts_record, unnest(range(2 + CASE WHEN {draw_sql(42, 'event_id')} < 500000 THEN 1 ELSE 0 END)) AS copy FROM trace)""",
)
def thickened(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sm.rescale(fixtures.trace(spark, folder), 2.5, ["event_id"]).select("event_id", "copy", "ts_record"), 3)


@query(
    "ag21_rescale_report",
    with_views(TRACE, REPLAYED)
    + f""" SELECT chunk, count(*) AS num_io_ori, count(*) FILTER (WHERE io_type = 1) AS read_ori, count(*) FILTER (WHERE io_type = 0) AS write_ori,
    count(*) FILTER (WHERE k) AS num_io_rescaled, count(*) FILTER (WHERE k AND io_type = 1) AS read_rescaled, count(*) FILTER (WHERE k AND io_type = 0) AS write_rescaled
  FROM (SELECT *, {draw_sql(42, 'event_id')} < 500000 AS k FROM replayed) GROUP BY 1""",
)
def rescale_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder)
    return sm.rescale_report(rows, sm.rescale(rows, 0.5, ["event_id"]), ["chunk"])


_POOL = f"""picked AS (SELECT metric, multiplier, name, row_number() OVER (PARTITION BY metric, multiplier ORDER BY {draw_sql(42, 'name')}, name) AS pick FROM bucket WHERE multiplier <> 1),
base AS (SELECT metric, min(name) AS name FROM bucket WHERE multiplier = 1 GROUP BY 1)"""


@query(
    "sm3_pool_lists",
    with_views(TRACE, buckets_sql(), _POOL)
    + """ SELECT metric, multiplier, pick + 1 AS key, name FROM picked SEMI JOIN base USING (metric) WHERE pick <= 15
  UNION ALL SELECT metric, multiplier, 1, base.name FROM base JOIN (SELECT DISTINCT metric, multiplier FROM picked) USING (metric)""",
)
def pool_lists(spark: SparkSession, folder: str) -> DataFrame:
    return sm.pool_list(buckets(spark, folder))


@query(
    "sm3_sample_lists",
    with_views(TRACE, buckets_sql())
    + f""", s AS (SELECT * FROM bucket, (SELECT CAST(unnest(range(5)) AS INTEGER) AS sample))
  SELECT metric, sample, multiplier, name FROM s QUALIFY row_number() OVER (PARTITION BY metric, sample, multiplier ORDER BY {draw_sql(42, 'sample', 'name')}, name) = 1""",
)
def sample_lists(spark: SparkSession, folder: str) -> DataFrame:
    return sm.sample_lists(buckets(spark, folder))


def _schedule_sql(n: int) -> str:
    block, half = int(n / 1.5), n // 2
    mixes = " UNION ALL ".join(
        f"""SELECT metric, 'gradual', rank - 1, {i}, 0, rank, {i}, 1 FROM st WHERE ranks >= 3 AND rank > 1
  UNION ALL SELECT metric, 'gradual', rank, {i}, 1, rank, {4 - i}, 1 FROM st WHERE ranks >= 3 AND rank < ranks"""
        for i in (1, 2, 3)
    )
    return f"""big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY metric, multiplier) AS c FROM bucket) WHERE c > {n}),
st AS (SELECT *, max(rank) OVER (PARTITION BY metric) AS ranks FROM (SELECT DISTINCT metric, multiplier, dense_rank() OVER (PARTITION BY metric ORDER BY multiplier) AS rank FROM big)),
pool AS (SELECT metric, rank, multiplier, name, row_number() OVER (PARTITION BY metric, multiplier ORDER BY {draw_sql(3003, 'metric', 'name')}, metric, name) AS pick FROM big JOIN st USING (metric, multiplier)),
part(metric, type, part, half, mix, rank, hi, lo) AS (
  SELECT metric, 'sudden', rank, 0, 0, rank, {n}, 1 FROM st
  UNION ALL SELECT metric, 'gradual', rank, 0, 0, rank, {block}, 1 FROM st WHERE ranks >= 3 UNION ALL {mixes}
  UNION ALL SELECT metric, 'incremental', rank, 0, 0, rank, CASE WHEN rank IN (1, ranks) THEN {n} ELSE 5 END, 1 FROM st WHERE ranks > 2
  UNION ALL SELECT metric, 'recurring', 2 * j + CASE WHEN rank = 1 THEN 0 ELSE 1 END, 0, 0, rank, CASE WHEN j = 0 THEN {half} ELSE {n} END, CASE WHEN j = 0 THEN 1 ELSE {n - half + 1} END
    FROM st, (VALUES (0), (1)) v(j) WHERE ranks >= 2 AND rank IN (1, ranks))
SELECT metric, type, row_number() OVER (PARTITION BY metric, type ORDER BY part, half, mix, pick) AS position, multiplier, name
  FROM part JOIN pool USING (metric, rank) WHERE pick BETWEEN lo AND hi"""


_BY_VALUE = """bucket AS (SELECT name, 'size_avg' AS metric, size_avg AS value, floor(size_avg / 20000) + 1 AS multiplier FROM named
  UNION ALL SELECT name, 'num_io', num_io, least(num_io, 5) FROM named)"""


def coarse_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets wide enough to hold many windows."""
    from spindle.plans.joins import named_windows

    named = named_windows(spark, folder)
    sizes = named.select("name", F.lit("size_avg").alias("metric"), F.col("size_avg").alias("value"), (F.floor(F.col("size_avg") / 20000) + 1).cast("double").alias("multiplier"))
    counts = named.select("name", F.lit("num_io").alias("metric"), F.col("num_io").cast("double").alias("value"), F.least("num_io", F.lit(5)).cast("double").alias("multiplier"))
    return sizes.unionByName(counts)


def _coarse_sql() -> str:
    from spindle.plans.joins import NAMED

    return with_views(TRACE, NAMED, _BY_VALUE)


@query("sm4_drift_schedules", _coarse_sql() + ", " + _schedule_sql(30))
def drift_schedules(spark: SparkSession, folder: str) -> DataFrame:
    return sm.drift_schedules(coarse_buckets(spark, folder), 30)


@query(
    "sm5_variations",
    with_views(TRACE, buckets_sql())
    + f""", v AS (SELECT * FROM bucket, (SELECT CAST(unnest(range(4)) AS INTEGER) AS variation)),
  c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY variation, metric, multiplier ORDER BY {draw_sql(42, 'variation', 'metric', 'name')}, variation, metric, name) = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY variation ORDER BY {draw_sql(43, 'variation', 'metric', 'multiplier', 'name')}, variation, metric, multiplier, name) AS position FROM c)
  SELECT variation, position, metric, multiplier, name FROM p WHERE position <= 6""",
)
def variations(spark: SparkSession, folder: str) -> DataFrame:
    return sm.variations(buckets(spark, folder), 4, 6)


@query(
    "sm6_class_top_up",
    with_views(TRACE, PREDICTION)
    + f""", a AS (SELECT window_id, row_id, label AS reject, probability FROM prediction),
  s AS (SELECT * FROM a WHERE CASE window_id % 3 WHEN 0 THEN reject = 1 WHEN 1 THEN reject = 0 ELSE probability > 0.7 END),
  h AS (SELECT window_id, count(*) FILTER (WHERE reject = 1) AS ones, count(*) FILTER (WHERE reject = 0) AS zeros FROM s GROUP BY 1),
  f AS (SELECT window_id, count(*) FILTER (WHERE reject = 1) AS all_ones, count(*) FILTER (WHERE reject = 0) AS all_zeros FROM a GROUP BY 1),
  n AS (SELECT window_id, CASE WHEN zeros = 0 THEN 0 WHEN ones = 0 THEN 1 END AS cls,
    CASE WHEN zeros = 0 THEN CASE WHEN ones // 4 > all_zeros THEN all_zeros // 4 ELSE ones // 4 END
      ELSE CASE WHEN zeros // 4 > all_ones THEN all_ones // 4 ELSE zeros // 4 END END AS amount FROM h JOIN f USING (window_id)),
  x AS (SELECT window_id, row_id, reject FROM (SELECT a.*, amount, row_number() OVER (PARTITION BY window_id ORDER BY {draw_sql(42, 'row_id')}, row_id) AS pick
    FROM a JOIN n USING (window_id) WHERE reject = cls) WHERE pick <= amount)
  SELECT window_id, row_id, reject FROM s UNION ALL SELECT * FROM x""",
)
def class_top_up(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.prediction(spark, folder).select("window_id", "row_id", F.col("label").alias("reject"), "probability")
    kind = F.col("window_id") % 3
    keep = F.when(kind == 0, F.col("reject") == 1).when(kind == 1, F.col("reject") == 0).otherwise(F.col("probability") > 0.7)
    slim = rows.drop("probability")
    return sm.top_up_missing_class(rows.where(keep).drop("probability"), slim, ["window_id"], ["row_id"])


@query("sm7_random_split", with_views(TRACE) + f" SELECT event_id, {draw_sql(42, 'event_id')} < 200000 AS is_test FROM trace")
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    return sm.split_rows(fixtures.trace(spark, folder), ["event_id"]).select("event_id", "is_test")


@query(
    "sm7_time_split",
    with_views(TRACE)
    + """ SELECT event_id, row_number() OVER (PARTITION BY disk_id ORDER BY ts_record, event_id) > floor(count(*) OVER (PARTITION BY disk_id) * 70 / 100) AS is_test FROM trace""",
)
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    return sm.split_by_time(fixtures.trace(spark, folder), ["disk_id"], ["ts_record", "event_id"], 70).select("event_id", "is_test")


@query(
    "sm8_capped_rows",
    with_views(TRACE)
    + f""" SELECT event_id, disk_id FROM trace QUALIFY row_number() OVER (PARTITION BY disk_id, io_type ORDER BY {draw_sql(42, 'event_id')}, event_id) <= 250""",
)
def capped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The cap is the feature here: a side-by-side comparison of equal numbers of rows."""
    return sm.cap_rows(fixtures.trace(spark, folder), ["disk_id", "io_type"], ["event_id"], 250).select("event_id", "disk_id")


@query("so3_largest_models", with_views(TRACE) + " SELECT disk_id, io_type, count(*) AS n FROM trace GROUP BY ALL ORDER BY n DESC, disk_id, io_type LIMIT 10")
def largest_models(spark: SparkSession, folder: str) -> DataFrame:
    counts = fixtures.trace(spark, folder).groupBy("disk_id", "io_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "disk_id", "io_type").limit(10)
