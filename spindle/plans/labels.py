"""Labels, outliers and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import features, label, sequence
from spindle.operators.distribution import tangent_knee
from spindle.operators.ordered import ordered
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import REPLAYED, TRACE, with_views

KEYS = ["disk_id", "chunk"]
ORDER = ["ts_submit", "event_id"]

# thresholds per device and chunk, then the period walk row by row
_KNEES = """r AS (SELECT *, {throughput} AS throughput FROM {source}),
long AS (SELECT disk_id, chunk, 'latency' AS metric, CAST(latency AS DOUBLE) AS v FROM r
  UNION ALL SELECT disk_id, chunk, 'throughput', CAST(throughput AS DOUBLE) FROM r),
cut AS (SELECT disk_id, chunk, metric, quantile_cont(v, 0.97) AS cut, quantile_cont(v, 0.5) AS median FROM long GROUP BY ALL),
kept AS (SELECT long.*, max(v) OVER p AS top, count(*) OVER p AS n FROM long JOIN cut USING (disk_id, chunk, metric) WHERE v <= cut
  WINDOW p AS (PARTITION BY disk_id, chunk, metric)),
pts AS (SELECT disk_id, chunk, metric, top, n, g, sum(c) AS c FROM (
    SELECT disk_id, chunk, metric, top, n, CAST(ceil(v / top * 9999) AS BIGINT) AS g, 1 AS c FROM kept
    UNION ALL SELECT DISTINCT disk_id, chunk, metric, top, n, 0, 0 FROM kept) GROUP BY ALL),
curve AS (SELECT *, sum(c) OVER (PARTITION BY disk_id, chunk, metric ORDER BY g) / n AS y FROM pts),
knee AS (SELECT disk_id, chunk, metric, floor(CAST(g AS DOUBLE) / 9999 * top) AS knee, y * 0.97 * 100 AS percent FROM curve
  QUALIFY row_number() OVER (PARTITION BY disk_id, chunk, metric ORDER BY y - CAST(g AS DOUBLE) / 9999 DESC, g) = 1),
th AS (SELECT disk_id, chunk, max(knee) FILTER (WHERE metric = 'latency') AS latency_knee,
    max(knee) FILTER (WHERE metric = 'throughput') AS throughput_knee,
    max(percent) FILTER (WHERE metric = 'latency') AS latency_knee_percent,
    max(percent) FILTER (WHERE metric = 'throughput') AS throughput_knee_percent,
    max(median) FILTER (WHERE metric = 'latency') AS latency_median,
    max(median) FILTER (WHERE metric = 'throughput') AS throughput_median
  FROM knee JOIN cut USING (disk_id, chunk, metric) GROUP BY ALL)"""

_ROUNDED = "round_even(size / latency, 0)"
KNEES_SQL = _KNEES.format(throughput=_ROUNDED, source="replayed")
_PERIODS = """seq AS (SELECT r.*, latency_knee, throughput_knee, latency_median, throughput_median,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY disk_id, chunk) AS rows,
    round_even(coalesce(lag(throughput) OVER w, 0) / (throughput + 0.1) * 10, 0) / 10 AS throughput_drop,
    throughput >= throughput_median AND coalesce(lead(throughput, 1) OVER w, 0) >= throughput_median
      AND coalesce(lead(throughput, 2) OVER w, 0) >= throughput_median AS back
  FROM r JOIN th USING (disk_id, chunk) WINDOW w AS (PARTITION BY disk_id, chunk ORDER BY ts_submit, event_id)),
starts AS (SELECT *, NOT (throughput > throughput_knee OR latency < latency_knee) AND throughput_drop >= 1.7 AS gc_start FROM seq),
walk AS (SELECT disk_id, chunk, rn, gc_start AS state FROM starts WHERE rn = 1
  UNION ALL SELECT s.disk_id, s.chunk, s.rn,
    CASE WHEN s.rn = s.rows THEN s.gc_start WHEN w.state THEN NOT s.back ELSE s.gc_start END
  FROM walk w JOIN starts s ON s.disk_id = w.disk_id AND s.chunk = w.chunk AND s.rn = w.rn + 1),
marked AS (SELECT s.*, CAST(state AS INTEGER) AS tail FROM starts s JOIN walk w USING (disk_id, chunk, rn))"""
_OUTLIERS = """judged AS (SELECT *, CASE WHEN tail = 1 AND latency <= latency_median AND throughput >= throughput_median THEN 1
    WHEN tail = 0 AND latency > latency_knee AND throughput < throughput_median THEN 2 ELSE 0 END AS o12 FROM marked),
isl AS (SELECT *, sum(turn) OVER (PARTITION BY disk_id, chunk ORDER BY ts_submit, event_id) AS island FROM (
  SELECT *, CASE WHEN tail = lag(tail) OVER (PARTITION BY disk_id, chunk ORDER BY ts_submit, event_id) THEN 0 ELSE 1 END AS turn
  FROM judged WHERE o12 = 0)),
sized AS (SELECT *, count(*) OVER (PARTITION BY disk_id, chunk, island) AS island_size FROM isl),
outliers AS (SELECT event_id, CASE WHEN tail = 1 AND island_size <= 3 THEN 3 ELSE 0 END AS outlier FROM sized
  UNION ALL SELECT event_id, o12 FROM judged WHERE o12 <> 0)"""
LABEL_SQL = with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS)
OUTLIER_SQL = with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS, _OUTLIERS)

_PREV = ", ".join(f"lag({c}, {i}) OVER d AS prev_{c}_{i}" for c in ("queue_len", "latency", "throughput") for i in (1, 2, 3))
_FEATURE_COLUMNS = "size, queue_len, " + ", ".join(f"prev_{c}_{i}" for c in ("queue_len", "latency", "throughput") for i in (1, 2, 3))
_FEATURES = f"""queued AS (SELECT *, row_number() OVER (PARTITION BY disk_id, chunk, ts_submit ORDER BY event_id) AS queue_len FROM marked),
lagged AS (SELECT *, {_PREV} FROM queued WINDOW d AS (PARTITION BY disk_id ORDER BY chunk, ts_submit, event_id)),
features AS (SELECT event_id, disk_id, chunk, ts_submit, io_type, {_FEATURE_COLUMNS}, latency,
  CASE WHEN io_type = 0 THEN 0 ELSE tail END AS reject FROM lagged WHERE prev_queue_len_3 IS NOT NULL)"""
FEATURES_SQL = with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS, _FEATURES)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return label.label_slow(fixtures.replayed(spark, folder), KEYS, ORDER)


def features_of(spark: SparkSession, folder: str) -> DataFrame:
    made = features.feature_set(labelled(spark, folder), ["disk_id"], "chunk", ORDER, trace=fixtures.replayed(spark, folder))
    return made.drop("ts_record", "offset", "size_after_replay")


@query(
    "ds9_tangent_knee",
    with_views(TRACE, REPLAYED, KNEES_SQL)
    + """ SELECT disk_id, chunk, latency_knee, throughput_knee, round(latency_knee_percent, 6) AS latency_knee_percent,
    round(throughput_knee_percent, 6) AS throughput_knee_percent FROM th""",
)
def knees(spark: SparkSession, folder: str) -> DataFrame:
    rows = label.rounded_throughput(fixtures.replayed(spark, folder))
    return rounded(tangent_knee(rows, KEYS, {"latency": F.col("latency"), "throughput": F.col("throughput")}))


@query("lb1_label_slow", LABEL_SQL + " SELECT event_id, tail AS reject FROM marked")
def label_slow(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("event_id", "reject")


@query("lb1_label_slow_filtered", OUTLIER_SQL + " SELECT event_id, tail AS reject FROM judged JOIN outliers USING (event_id) WHERE outlier = 0")
def label_slow_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return label.label_slow(fixtures.replayed(spark, folder), KEYS, ORDER, filter_outliers=True).select("event_id", "reject")


@query("lb2_gc_start", LABEL_SQL + " SELECT event_id, throughput_drop, gc_start FROM marked")
def gc_start(spark: SparkSession, folder: str) -> DataFrame:
    marked = label.mark_slow(fixtures.replayed(spark, folder), KEYS, ORDER).frame()
    return marked.select("event_id", "throughput_drop", "gc_start")


@query("wf15_tail_periods", LABEL_SQL + " SELECT disk_id, chunk, count(*) AS n, sum(tail)::BIGINT AS slow, max(rn) FILTER (WHERE tail = 1) AS last_slow FROM marked GROUP BY ALL")
def tail_periods(spark: SparkSession, folder: str) -> DataFrame:
    rows = label.mark_slow(fixtures.replayed(spark, folder), KEYS, ORDER).numbered("rn").frame()
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tail").alias("slow"), F.max(F.when(F.col("tail") == 1, F.col("rn"))).alias("last_slow")
    )


@query("lb3_fast_and_slow_outliers", OUTLIER_SQL + " SELECT event_id, o12 AS outlier FROM judged WHERE o12 <> 0")
def fast_and_slow_outliers(spark: SparkSession, folder: str) -> DataFrame:
    marked = label.label_with_outliers(fixtures.replayed(spark, folder), KEYS, ORDER)
    return marked.where(F.col("outlier").isin(1, 2)).select("event_id", "outlier")


@query("lb4_short_periods", OUTLIER_SQL + " SELECT event_id, outlier FROM outliers")
def short_periods(spark: SparkSession, folder: str) -> DataFrame:
    return label.label_with_outliers(fixtures.replayed(spark, folder), KEYS, ORDER).select("event_id", "outlier")


_GIVEN = "given AS (SELECT *, CASE WHEN event_id % 20 < 6 THEN 1 ELSE 0 END AS tail FROM replayed)"


@query(
    "lb5_filter_labelled",
    with_views(
        TRACE,
        REPLAYED,
        _GIVEN,
        _KNEES.format(throughput="size / latency", source="given"),
        "marked AS (SELECT r.*, latency_knee, latency_median, throughput_median FROM r JOIN th USING (disk_id, chunk))",
        _OUTLIERS,
    )
    + " SELECT event_id, tail AS reject FROM judged JOIN outliers USING (event_id) WHERE outlier = 0",
)
def filter_labelled(spark: SparkSession, folder: str) -> DataFrame:
    given = fixtures.replayed(spark, folder).withColumn("reject", F.when(F.col("event_id") % 20 < 6, 1).otherwise(0))
    return label.filter_labelled(given, KEYS, ORDER).select("event_id", "reject")


@query(
    "lb6_label_report",
    OUTLIER_SQL
    + """ SELECT disk_id, chunk, count(*) AS num_io, count(*) FILTER (WHERE io_type = 1) AS reads, count(*) FILTER (WHERE io_type = 0) AS writes,
    count(*) FILTER (WHERE outlier = 1) AS outlier1, count(*) FILTER (WHERE outlier = 2) AS outlier2, count(*) FILTER (WHERE outlier = 3) AS outlier3,
    count(*) FILTER (WHERE outlier = 0) AS labelled, count(*) FILTER (WHERE outlier = 0 AND tail = 0) AS fast,
    count(*) FILTER (WHERE outlier = 0 AND tail = 1) AS slow, count(*) FILTER (WHERE outlier = 0 AND io_type = 1) AS labelled_reads,
    count(*) FILTER (WHERE outlier = 0 AND io_type = 1 AND tail = 0) AS fast_reads,
    count(*) FILTER (WHERE outlier = 0 AND io_type = 1 AND tail = 1) AS slow_reads
  FROM judged JOIN outliers USING (event_id) GROUP BY ALL""",
)
def label_report(spark: SparkSession, folder: str) -> DataFrame:
    marked = label.label_with_outliers(fixtures.replayed(spark, folder), KEYS, ORDER)
    report = label.label_report(marked, KEYS)
    return report.drop("labelled_percent", "fast_percent", "slow_percent", "cdf_gain")


@query(
    "lb7_latency_knee_label",
    with_views(TRACE, REPLAYED, KNEES_SQL)
    + " SELECT event_id, CASE WHEN latency >= latency_knee THEN 1 ELSE 0 END AS slow FROM r JOIN th USING (disk_id, chunk)",
)
def latency_knee_label(spark: SparkSession, folder: str) -> DataFrame:
    return label.knee_label(fixtures.replayed(spark, folder), KEYS).select("event_id", "slow")


@query(
    "lb8_label_difference",
    with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS)
    + """, slow AS (SELECT event_id, CASE WHEN latency >= latency_knee THEN 1 ELSE 0 END AS reject FROM marked),
  old AS (SELECT event_id, tail AS reject FROM marked)
  SELECT *, 'left' AS side FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM slow)
  UNION ALL SELECT *, 'right' FROM (SELECT * FROM slow EXCEPT ALL SELECT * FROM old)""",
)
def label_difference(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder)
    left = rows.select("event_id", "reject")
    right = label.knee_label(rows, KEYS).select("event_id", F.col("slow").alias("reject"))
    return label.label_difference(left, right)


@query("fe1_feature_set", FEATURES_SQL + " SELECT * FROM features")
def feature_set(spark: SparkSession, folder: str) -> DataFrame:
    return features_of(spark, folder)


@query("fe1_feature_set_reads", FEATURES_SQL + " SELECT * EXCLUDE (io_type) FROM features WHERE io_type = 1")
def feature_set_reads(spark: SparkSession, folder: str) -> DataFrame:
    return features.readonly(features_of(spark, folder))


@query(
    "fe3_per_device",
    FEATURES_SQL + " SELECT disk_id, count(*) AS n, sum(reject)::BIGINT AS rejects, sum(queue_len)::BIGINT AS queued, sum(prev_latency_3)::BIGINT AS latency3 FROM features GROUP BY 1",
)
def per_device(spark: SparkSession, folder: str) -> DataFrame:
    rows = features_of(spark, folder).groupBy("disk_id")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("reject").alias("rejects"), F.sum("queue_len").alias("queued"), F.sum("prev_latency_3").alias("latency3")
    )


_STATIC = f"""queued AS (SELECT *, row_number() OVER (PARTITION BY disk_id, chunk, ts_submit ORDER BY event_id) AS queue_len FROM marked),
firsts AS (SELECT disk_id, min(chunk) AS first_chunk FROM queued GROUP BY 1),
heads AS (SELECT queued.* FROM queued JOIN firsts USING (disk_id) WHERE chunk = first_chunk
  QUALIFY row_number() OVER (PARTITION BY disk_id ORDER BY ts_submit DESC, event_id DESC) <= 3),
both_rows AS (SELECT 1 AS own, * FROM queued
  UNION ALL SELECT 0, heads.* REPLACE (later.chunk AS chunk) FROM heads
    JOIN (SELECT DISTINCT disk_id, chunk FROM queued JOIN firsts USING (disk_id) WHERE chunk <> first_chunk) later USING (disk_id)),
lagged AS (SELECT *, {_PREV} FROM both_rows WINDOW d AS (PARTITION BY disk_id, chunk ORDER BY own, ts_submit, event_id)),
features AS (SELECT event_id, disk_id, chunk, ts_submit, io_type, {_FEATURE_COLUMNS}, latency,
  CASE WHEN io_type = 0 THEN 0 ELSE tail END AS reject FROM lagged WHERE own = 1 AND prev_queue_len_3 IS NOT NULL)"""


@query("fe4_static_history", with_views(TRACE, REPLAYED, KNEES_SQL, _PERIODS, _STATIC) + " SELECT * FROM features")
def static_history(spark: SparkSession, folder: str) -> DataFrame:
    trace = fixtures.replayed(spark, folder)
    made = features.feature_set(labelled(spark, folder), ["disk_id"], "chunk", ORDER, rolling=False, trace=trace)
    return made.drop("ts_record", "offset", "size_after_replay")


@query(
    "wf4_previous_values",
    FEATURES_SQL + " SELECT event_id, prev_queue_len_1, prev_latency_2, prev_throughput_3 FROM features",
)
def previous_values(spark: SparkSession, folder: str) -> DataFrame:
    return features_of(spark, folder).select("event_id", "prev_queue_len_1", "prev_latency_2", "prev_throughput_3")


@query(
    "wf6_change_ratios",
    FEATURES_SQL
    + """ SELECT event_id, round_even(latency / prev_latency_1 * 100, 0) / 100 AS latency_increase,
    round_even(prev_throughput_1 / (throughput + 0.1) * 100, 0) / 100 AS throughput_drop
  FROM lagged WHERE prev_queue_len_3 IS NOT NULL""",
)
def change_ratios(spark: SparkSession, folder: str) -> DataFrame:
    made = features.change_ratios(features_of(spark, folder))
    return made.select("event_id", "latency_increase", "throughput_drop")


_GC = """r AS (SELECT *, size / latency AS throughput FROM replayed),
sl AS (SELECT *, latency - coalesce(lag(latency) OVER w, 0) AS sl, throughput - coalesce(lag(throughput) OVER w, 0) AS st, row_number() OVER w AS rn
  FROM r WINDOW w AS (PARTITION BY disk_id, chunk ORDER BY ts_submit, event_id)),
fences AS (SELECT disk_id, chunk, quantile_cont(sl, 0.25) AS l25, quantile_cont(sl, 0.75) AS l75,
    quantile_cont(st, 0.25) AS t25, quantile_cont(st, 0.5) AS t50, quantile_cont(st, 0.75) AS t75 FROM sl GROUP BY ALL)"""


def gc_fences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows with slopes, and the quartile fences of the slopes per device and chunk."""
    from spindle.functions.scalars import throughput
    from spindle.operators.selection import order_statistics

    rows = fixtures.replayed(spark, folder).withColumn("throughput", throughput(F.col("size"), F.col("latency")))
    sloped = sequence.slopes(ordered(rows, KEYS, ORDER), ["latency", "throughput"]).frame()
    stats = order_statistics(sloped, KEYS, {"l": F.col("slope_latency"), "t": F.col("slope_throughput")}, [0.25, 0.5, 0.75])
    low, high = F.col("l_pct")[0], F.col("l_pct")[2]
    fences = stats.select(
        *KEYS,
        (high + 3 * (high - low)).alias("latency_high"),
        (low - 3 * (high - low)).alias("latency_low"),
        F.col("t_pct")[0].alias("throughput_q25"),
        F.col("t_pct")[1].alias("throughput_q50"),
        F.col("t_pct")[2].alias("throughput_q75"),
    )
    return sloped, fences


@query(
    "wf20_slopes",
    with_views(TRACE, REPLAYED, _GC)
    + """ SELECT event_id, sl::DOUBLE AS slope_latency, round(st, 6) AS slope_throughput,
    round(CASE WHEN rn = 1 THEN 0 ELSE latency / lag(latency) OVER w END, 6) AS ratio_latency
  FROM sl WINDOW w AS (PARTITION BY disk_id, chunk ORDER BY ts_submit, event_id)""",
)
def slopes(spark: SparkSession, folder: str) -> DataFrame:
    sloped, _ = gc_fences(spark, folder)
    both = sequence.slopes(ordered(sloped, KEYS, ORDER), ["latency"], ratios=True).frame()
    return rounded(both.select("event_id", F.col("slope_latency").cast("double").alias("slope_latency"), "slope_throughput", "ratio_latency"))


@query(
    "wf21_fences",
    with_views(TRACE, REPLAYED, _GC)
    + """ SELECT disk_id, chunk, round(l75 + 3 * (l75 - l25), 6) AS latency_high, round(l25 - 3 * (l75 - l25), 6) AS latency_low,
    round(t25, 6) AS throughput_q25, round(t50, 6) AS throughput_q50, round(t75, 6) AS throughput_q75 FROM fences""",
)
def fences(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(gc_fences(spark, folder)[1])


# one CASE per row of the walk: states are 0 idle, 1 idle after a write, 2 inside an interval
_GC_WALK = """kinds AS (SELECT sl.*, io_type = 1 AND size > 4096 AS big,
    sl > l75 + 1.5 * (l75 - l25) AND st < t25 AS a, NOT st > t50 AS m, sl < l25 - 1.5 * (l75 - l25) AND st > t75 AS z
  FROM sl JOIN fences USING (disk_id, chunk)),
walk AS (SELECT disk_id, chunk, 0::BIGINT AS rn, 0 AS state FROM (SELECT DISTINCT disk_id, chunk FROM kinds)
  UNION ALL SELECT k.disk_id, k.chunk, k.rn, CASE
    WHEN w.state < 2 AND k.io_type = 0 THEN 1
    WHEN w.state < 2 AND k.big AND (k.a OR (w.state = 1 AND k.m)) THEN 2
    WHEN w.state = 2 AND k.big AND k.z THEN 0
    ELSE w.state END
  FROM walk w JOIN kinds k ON k.disk_id = w.disk_id AND k.chunk = w.chunk AND k.rn = w.rn + 1)"""


@query(
    "wf22_gc_labels",
    with_views(TRACE, REPLAYED, _GC, _GC_WALK)
    + " SELECT event_id, CASE WHEN big AND state = 2 THEN 1 ELSE 0 END AS reject FROM kinds JOIN walk USING (disk_id, chunk, rn)",
)
def gc_labels(spark: SparkSession, folder: str) -> DataFrame:
    """With the inner fences, so that intervals also end."""
    rows = fixtures.replayed(spark, folder)
    _, wide = gc_fences(spark, folder)
    spread = (F.col("latency_high") - F.col("latency_low")) / 7
    inner = wide.withColumns({"latency_high": F.col("latency_high") - 1.5 * spread, "latency_low": F.col("latency_low") + 1.5 * spread})
    return sequence.gc_labels(rows, KEYS, ORDER, inner).select("event_id", "reject")


_PENDING = """ev AS (SELECT *, CAST(floor(ts_submit * 1000) AS BIGINT) AS issue, CAST(floor((size / 512 + 7) / 8) AS BIGINT) AS pages FROM replayed),
steps AS (SELECT *, issue AS tm, 0 AS kind, pages AS delta FROM ev UNION ALL SELECT *, issue + latency, 1, -pages FROM ev),
flow AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY disk_id ORDER BY tm, event_id, kind) AS BIGINT) AS pending FROM steps),
seen AS (SELECT event_id, pending FROM flow WHERE kind = 0),
reads AS (SELECT flow.* EXCLUDE (pending), seen.pending AS seen FROM flow JOIN seen USING (event_id) WHERE io_type = 1),
hist AS (SELECT *, list([latency, seen]) FILTER (WHERE kind = 1) OVER (PARTITION BY disk_id ORDER BY tm, event_id, kind) AS done FROM reads),
vectors AS (SELECT disk_id, event_id, seen AS pending, list_transform(done[-4:], lambda d: d[2]) AS hist_pending,
  list_transform(done[-4:], lambda d: d[1]) AS hist_latency, latency FROM hist WHERE kind = 0 AND len(done) >= 4)"""


@query("wf18_pending_pages", with_views(TRACE, REPLAYED, _PENDING) + " SELECT event_id, pending FROM vectors")
def pending_pages(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.pending(fixtures.replayed(spark, folder), ["disk_id"], "event_id").select("event_id", "pending")


@query("wf19_completed_reads", with_views(TRACE, REPLAYED, _PENDING) + " SELECT event_id, hist_pending, hist_latency, latency FROM vectors")
def completed_reads(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.pending_and_history(fixtures.replayed(spark, folder), ["disk_id"], "event_id")
    return rows.select("event_id", "hist_pending", "hist_latency", "latency")


@query(
    "fe2_digit_vector",
    with_views(TRACE, REPLAYED, _PENDING)
    + """ SELECT event_id, list_transform(string_split(
      list_aggregate(list_transform(list_append(hist_pending, pending), lambda v: lpad(CAST(least(v, 999) AS VARCHAR), 3, '0')), 'string_agg', '')
      || list_aggregate(list_transform(hist_latency, lambda v: lpad(CAST(least(v, 9999) AS VARCHAR), 4, '0')), 'string_agg', ''), ''),
    lambda c: CAST(c AS INTEGER)) AS digits, latency FROM vectors""",
)
def digit_vector(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.pending_and_history(fixtures.replayed(spark, folder), ["disk_id"], "event_id")
    return sequence.digit_vector(rows).select("event_id", "digits", "latency")


