"""Counts, statistics and characteristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import stats

from spindle.operators import characteristic as ch
from spindle.operators import evaluate as ev
from spindle.operators import sampling
from spindle.operators.distribution import describe as describe_column
from spindle.operators.ordered import Groups
from spindle.operators.windows import first_time, split_windows
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import HOUR_MS, PREDICTION, REPLAYED, TRACE, with_views

P = stats.PERCENTILES


@query("ag1_device_counts", with_views(TRACE) + " SELECT disk_id, count(*) AS n FROM trace GROUP BY 1")
def device_counts(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.trace(spark, folder).groupBy("disk_id").agg(F.count(F.lit(1)).alias("n"))


@query("ag1_supplier_counts", "SELECT l_suppkey AS device, count(*) AS n FROM lineitem GROUP BY 1")
def supplier_counts(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("device")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag2_counts_of_files",
    with_views(TRACE, REPLAYED) + " SELECT disk_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, disk_id) AS place FROM replayed GROUP BY 1 ORDER BY n DESC",
)
def counts_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per file first, as the files' counts may come from an earlier run; then their sum, largest first."""
    from spindle.operators.ordered import ordered

    per_file = fixtures.replayed(spark, folder).groupBy("chunk", "disk_id").agg(F.count(F.lit(1)).alias("n"))
    total = per_file.groupBy("disk_id").agg(F.sum("n").alias("n")).withColumn("_d", -F.col("n"))
    return ordered(total, [], ["_d", "disk_id"]).numbered("place").frame().drop("_d").orderBy(F.desc("n"), "disk_id")


@query("so2_devices_by_count", with_views(TRACE) + " SELECT disk_id, count(*) AS n FROM trace GROUP BY 1 ORDER BY n DESC, disk_id")
def devices_by_count(spark: SparkSession, folder: str) -> DataFrame:
    return device_counts(spark, folder).orderBy(F.desc("n"), "disk_id")


@query("ag3_first_time", with_views(TRACE) + " SELECT min(ts_record) AS start_ts FROM trace")
def first(spark: SparkSession, folder: str) -> DataFrame:
    return first_time(fixtures.trace(spark, folder))


def _moments_sql(name: str, expr: str, digits: int = 4) -> str:
    values = {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "variance": "var_pop", "std": "stddev_pop"}
    parts = [f"count({expr}) AS {name}_count"]
    if name.endswith("iat"):
        del values["variance"]  # too large to compare rounded; the deviation stays
    parts += [f"round(coalesce({fn}(CAST({expr} AS DOUBLE)), 0), {digits}) AS {name}_{s}" for s, fn in values.items()]
    return ", ".join(parts)


def _percentiles_sql(name: str, expr: str, digits: int = 4, points: dict[str, float] = P) -> str:
    parts = [f"round(coalesce(quantile_cont(CAST({expr} AS DOUBLE), {p}), 0), {digits}) AS {name}_{n}" for n, p in points.items()]
    if "p50" in points:
        parts.append(f"round(coalesce(quantile_cont(CAST({expr} AS DOUBLE), 0.5), 0), {digits}) AS {name}_median")
    return ", ".join(parts)


@query(
    "ag4_statistics",
    with_views(TRACE)
    + f""", m AS (SELECT disk_id, CAST(size AS DOUBLE) AS size_mode FROM trace GROUP BY disk_id, size
    QUALIFY row_number() OVER (PARTITION BY disk_id ORDER BY count(*) DESC, size) = 1)
  SELECT disk_id, size_mode, {_moments_sql("size", "size")}, round(quantile_cont(size, 0.5), 4) AS size_median
  FROM trace JOIN m USING (disk_id) GROUP BY disk_id, size_mode""",
)
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    wide = stats.statistics(fixtures.trace(spark, folder), ["disk_id"], {"size": F.col("size")})
    return rounded(wide.select("disk_id", *[f"size_{m}" for m in stats.MOMENTS]), 4)


@query(
    "ag5_percentiles",
    with_views(TRACE, REPLAYED) + f""" SELECT disk_id, {_percentiles_sql("latency", "latency", points={**P, **stats.FINER_PERCENTILES})} FROM replayed GROUP BY 1""",
)
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    points = {**P, **stats.FINER_PERCENTILES}
    wide = stats.statistics(fixtures.replayed(spark, folder), ["disk_id"], {"latency": F.col("latency")}, percentiles=points)
    return rounded(wide.select("disk_id", *[f"latency_{p}" for p in points], "latency_median"), 4)


@query(
    "ag5_selected_percentiles",
    with_views(TRACE, REPLAYED)
    + f""", m AS (SELECT disk_id, CAST(latency AS DOUBLE) AS latency_mode FROM replayed GROUP BY disk_id, latency
    QUALIFY row_number() OVER (PARTITION BY disk_id ORDER BY count(*) DESC, latency) = 1)
  SELECT disk_id, latency_mode, {_percentiles_sql("latency", "latency")}, {_percentiles_sql("throughput", "size / latency")}
  FROM replayed JOIN m USING (disk_id) GROUP BY disk_id, latency_mode""",
)
def selected_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """As for devices with more rows than a task may hold: ranks through sketches and counts."""
    rows = fixtures.replayed(spark, folder)
    metrics = {"latency": F.col("latency"), "throughput": F.col("size") / F.col("latency")}
    wide = stats.statistics(rows, ["disk_id"], metrics, groups=Groups.measure(rows, ["disk_id"], limit=500))
    return rounded(wide.select("disk_id", "latency_mode", *[f"{m}_{p}" for m in metrics for p in (*P, "median")]), 4)


@query(
    "ag6_iqr_bounds",
    with_views(TRACE, REPLAYED)
    + """ SELECT disk_id, round(q3 - q1, 4) AS latency_iqr, round(q1 - 1.5 * (q3 - q1), 4) AS latency_lower_iqr_bound,
    round(q3 + 1.5 * (q3 - q1), 4) AS latency_upper_iqr_bound, round(q1 - 3 * (q3 - q1), 4) AS latency_lower_outer_bound,
    round(q3 + 3 * (q3 - q1), 4) AS latency_upper_outer_bound
  FROM (SELECT disk_id, quantile_cont(latency, 0.25) AS q1, quantile_cont(latency, 0.75) AS q3 FROM replayed GROUP BY 1)""",
)
def iqr_bounds(spark: SparkSession, folder: str) -> DataFrame:
    wide = stats.statistics(fixtures.replayed(spark, folder), ["disk_id"], {"latency": F.col("latency")})
    bounded = stats.iqr_bounds(wide, "latency")
    names = [c for c in bounded.columns if c.endswith(("_iqr", "_bound"))]
    return rounded(bounded.select("disk_id", *names), 4)


# --- characteristics -------------------------------------------------------------------------------------------

_SIDES = {"": "TRUE", "read_": "io_type = 1", "write_": "io_type = 0"}


def _gaps_sql(keys: str, source: str = "trace") -> str:
    by, by_side = (f"PARTITION BY {keys}", f"PARTITION BY {keys}, io_type") if keys else ("", "PARTITION BY io_type")
    return f"""gaps AS (SELECT *, ts_record - lag(ts_record) OVER ({by} ORDER BY ts_record, event_id) AS gap,
    ts_record - lag(ts_record) OVER ({by_side} ORDER BY ts_record, event_id) AS side_gap FROM {source})"""


def _metric_exprs(latency: bool) -> dict[str, str]:
    out = {}
    for side, test in _SIDES.items():
        out[f"{side}size"] = f"CASE WHEN {test} THEN size END"
        out[f"{side}iat"] = "gap" if side == "" else f"CASE WHEN {test} THEN side_gap END"
        if latency:
            out[f"{side}latency"] = f"CASE WHEN {test} THEN latency END"
            out[f"{side}throughput"] = f"CASE WHEN {test} THEN size / latency END"
    return out


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _rates_sql() -> str:
    n, r, w = "count(*)", "count(*) FILTER (WHERE io_type = 1)", "count(*) FILTER (WHERE io_type = 0)"
    seconds = "((max(ts_record) - min(ts_record)) / 1000)"
    size = {s: f"coalesce(sum(size) FILTER (WHERE {t}), 0)" for s, t in _SIDES.items()}
    iat = {"": "coalesce(sum(gap), 0)", **{s: f"coalesce(sum(side_gap) FILTER (WHERE {t}), 0)" for s, t in _SIDES.items() if s}}
    cols = {"read_ratio": _ratio(r, n), "write_ratio": _ratio(w, n), "rw_ratio": _ratio(r, w)}
    for name, total in (("size", size), ("iat", iat)):
        cols[f"read_{name}_ratio"] = _ratio(total["read_"], total[""])
        cols[f"write_{name}_ratio"] = _ratio(total["write_"], total[""])
        cols[f"rw_{name}_ratio"] = _ratio(total["read_"], total["write_"])
    cols |= {"iops": _ratio(n, seconds), "read_iops": _ratio(r, seconds), "write_iops": _ratio(w, seconds)}
    cols |= {"bandwidth": _ratio(size[""], seconds), "read_bandwidth": _ratio(size["read_"], seconds), "write_bandwidth": _ratio(size["write_"], seconds)}
    shown = ", ".join(f"round({e}, 4) AS {c}" for c, e in cols.items())
    return f"""{n} AS num_io, min(ts_record) AS start_time, max(ts_record) AS end_time, round(max(ts_record) - min(ts_record), 4) AS duration,
    {r} AS read_count, {w} AS write_count, 'ms' AS ts_unit, {shown}"""


RATES = [
    "read_ratio", "write_ratio", "rw_ratio", "read_size_ratio", "write_size_ratio", "rw_size_ratio", "read_iat_ratio", "write_iat_ratio",
    "rw_iat_ratio", "iops", "read_iops", "write_iops", "bandwidth", "read_bandwidth", "write_bandwidth",
]


def _digits(column: str) -> int:
    """Digits that neither cut through the last bits of a metric's sums nor hit its exact halves."""
    return 0 if "iat" in column else 6 if "latency" in column else 4


def _stats_sql(latency: bool) -> str:
    exprs = _metric_exprs(latency)
    parts = [f"{_moments_sql(m, e, _digits(m))}, {_percentiles_sql(m, e, _digits(m))}" for m, e in exprs.items()]
    parts.append(f"count(\"offset\") AS offset_count, {_percentiles_sql('offset', chr(34) + 'offset' + chr(34), 4)}")
    return ", ".join(parts)


def _shown(wide: DataFrame) -> DataFrame:
    """All but the modes, which have a query of their own, and moments too large to compare rounded."""
    hidden = {f"offset_{m}" for m in ("sum", "avg", "min", "max", "variance", "std")}
    hidden |= {c for c in wide.columns if c.endswith(("_mode", "iat_variance"))}
    names = [c for c in wide.columns if c not in hidden]
    digits = {c: _digits(c) for c in names} | {c: 4 for c in [*RATES, "duration"]}
    return rounded(wide.select(*names), digits | {"start_time": 3, "end_time": 3})


def window_characteristics(spark: SparkSession, folder: str, width: str = "1h") -> DataFrame:
    return ch.characteristic(split_windows(fixtures.replayed(spark, folder), width), ["disk_id", "window_id"])


_WINDOWED = f"""moved AS (SELECT * REPLACE (ts_record - (SELECT min(ts_record) FROM replayed) AS ts_record),
    CAST(floor((ts_record - (SELECT min(ts_record) FROM replayed)) / {HOUR_MS}) AS BIGINT) AS window_id FROM replayed)"""
CHARACTERISTIC_SQL = (
    with_views(TRACE, REPLAYED, _WINDOWED, _gaps_sql("disk_id, window_id", "moved"))
    + f" SELECT disk_id, window_id, {_rates_sql().replace('min(ts_record) AS start_time, max(ts_record) AS end_time', 'round(min(ts_record), 3) AS start_time, round(max(ts_record), 3) AS end_time')}, {_stats_sql(True)} FROM gaps GROUP BY disk_id, window_id"
)


@query("ag7_window_characteristics", CHARACTERISTIC_SQL)
def window_characteristic(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(window_characteristics(spark, folder))


@query("ag8_ratios", with_views(TRACE, REPLAYED, _gaps_sql("disk_id", "replayed")) + f" SELECT disk_id, {_rates_sql()} FROM gaps GROUP BY disk_id")
def ratios(spark: SparkSession, folder: str) -> DataFrame:
    wide = ch.characteristic(fixtures.replayed(spark, folder), ["disk_id"], latency=False)
    names = ["disk_id", "num_io", "start_time", "end_time", "duration", "read_count", "write_count", "ts_unit", *RATES]
    return rounded(wide.select(*names), {c: 4 for c in names} | {"start_time": 6, "end_time": 6})


@query(
    "ag9_rates",
    with_views(TRACE, REPLAYED, "day AS (SELECT *, chunk AS day FROM replayed)", _gaps_sql("day", "day"))
    + f" SELECT day, iops, read_iops, write_iops, bandwidth, read_bandwidth, write_bandwidth FROM (SELECT day, {_rates_sql()} FROM gaps GROUP BY day)",
)
def rates(spark: SparkSession, folder: str) -> DataFrame:
    wide = ch.characteristic(fixtures.replayed(spark, folder).withColumnRenamed("chunk", "day"), ["day"], latency=False)
    names = ["iops", "read_iops", "write_iops", "bandwidth", "read_bandwidth", "write_bandwidth"]
    return rounded(wide.select("day", *names), 4)


_FIELDS = {"count": "count({e})", "sum": "sum({e})", "avg": "avg({e})", "min": "min({e})", "max": "max({e})", "variance": "var_pop({e})", "std": "stddev_pop({e})"}


@query(
    "ag10_statistic_ratios",
    with_views(TRACE)
    + " SELECT disk_id, "
    + ", ".join(
        f"round({_ratio(e.format(e='CASE WHEN io_type = 1 THEN size END'), e.format(e='CASE WHEN io_type = 0 THEN size END'))}, 6) AS rw_{s}"
        for s, e in {**_FIELDS, "p90": "quantile_cont({e}, 0.9)", "median": "quantile_cont({e}, 0.5)"}.items()
    )
    + ", round(0.001 * avg(size), 6) AS size_kb_avg FROM trace GROUP BY 1",
)
def statistic_ratios(spark: SparkSession, folder: str) -> DataFrame:
    wide = ch.characteristic(fixtures.trace(spark, folder), ["disk_id"])
    wide = stats.statistic_scaled(stats.statistic_ratio(wide, "read_size", "write_size", "rw"), "size", 0.001, "size_kb")
    names = [f"rw_{s}" for s in (*_FIELDS, "p90", "median")]
    return rounded(wide.select("disk_id", *names, "size_kb_avg"))


@query(
    "ag11_trace_characteristic",
    with_views(TRACE, REPLAYED, _gaps_sql("", "replayed")) + f" SELECT {_rates_sql()}, {_stats_sql(True)} FROM gaps",
)
def trace_characteristic(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(ch.characteristic(fixtures.replayed(spark, folder), []))


@query(
    "ag12_window_and_overall",
    with_views(TRACE, REPLAYED)
    + """, l AS (SELECT *, CASE WHEN latency > 700 THEN 1 ELSE 0 END AS reject FROM replayed)
  SELECT disk_id, chunk, count(*) AS num_io, count(*) FILTER (WHERE reject = 1) AS reject_count, count(*) FILTER (WHERE reject = 0) AS accept_count,
    round(avg(reject), 6) AS reject_ratio, round(avg(1 - reject), 6) AS accept_ratio, round(avg(size), 6) AS size_avg,
    round(quantile_cont(latency, 0.9), 6) AS latency_p90 FROM l GROUP BY GROUPING SETS ((disk_id, chunk), (disk_id))""",
)
def window_and_overall(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder).withColumn("reject", (F.col("latency") > 700).cast("int"))
    wide = ch.characteristic_with_overall(rows, "disk_id", "chunk")
    return rounded(wide.select("disk_id", "chunk", "num_io", "reject_count", "accept_count", "reject_ratio", "accept_ratio", "size_avg", "latency_p90"))


@query("ag13_distinct_disks", with_views(TRACE, REPLAYED) + " SELECT chunk, count(DISTINCT disk_id) AS num_disks FROM replayed GROUP BY 1")
def distinct_disks(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.replayed(spark, folder).groupBy("chunk").agg(F.count_distinct("disk_id").alias("num_disks"))


@query("ag13_disk_list", with_views(TRACE) + " SELECT DISTINCT disk_id FROM trace")
def disk_list(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.trace(spark, folder).select("disk_id").distinct()


@query(
    "ag14_replay_summary",
    with_views(TRACE, REPLAYED)
    + """, s AS (SELECT *, (size / 1024) / (latency / 1e6) AS thr, io_type = 1 AS rd FROM replayed)
  SELECT CAST(floor(count(*) FILTER (WHERE rd) * 100.0 / count(*)) AS BIGINT) AS read_percent, round(max(ts_record) / 1000, 2) AS duration_s,
    count(*) AS num_io, count(*) FILTER (WHERE rd) AS reads, count(*) FILTER (WHERE NOT rd) AS writes,
    round(count(*) / (max(ts_record) / 1000), 2) AS iops, round(count(*) FILTER (WHERE rd) / (max(ts_record) / 1000), 2) AS read_iops,
    round(count(*) FILTER (WHERE NOT rd) / (max(ts_record) / 1000), 2) AS write_iops,
    round(avg(thr) FILTER (WHERE rd) / 1000, 2) AS read_throughput, round(avg(thr) FILTER (WHERE NOT rd) / 1000, 2) AS write_throughput,
    round(avg(latency) FILTER (WHERE rd), 2) AS read_latency, round(avg(latency) FILTER (WHERE NOT rd), 2) AS write_latency,
    round(max(ts_record) / count(*), 2) AS interarrival FROM s""",
)
def replay_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ch.replay_summary(fixtures.replayed(spark, folder))


_HOURLY = f"""hourly AS (SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS window_id, count(*) AS num_io,
    avg(size) AS size_avg, quantile_cont(size, 0.9) AS size_p90 FROM trace GROUP BY ALL)"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).withColumn("window_id", F.floor(F.col("ts_record") / HOUR_MS))
    wide = stats.statistics(rows, ["disk_id", "window_id"], {"size": F.col("size")})
    return wide.select("disk_id", "window_id", F.col("size_count").alias("num_io"), "size_avg", "size_p90")


@query(
    "ag16_min_normalised",
    with_views(TRACE, _HOURLY)
    + """ SELECT disk_id, window_id, round(num_io / min(num_io) OVER (), 6) AS num_io, round(size_avg / min(size_avg) OVER (), 6) AS size_avg FROM hourly""",
)
def min_normalised(spark: SparkSession, folder: str) -> DataFrame:
    rows = hourly(spark, folder).drop("size_p90")
    return rounded(ch.normalise(rows, ["num_io", "size_avg"], "min"))


@query(
    "ag17_mean_normalised",
    with_views(TRACE, _HOURLY)
    + """ SELECT disk_id, window_id, round(num_io / avg(num_io) OVER d, 6) AS num_io, round(size_avg / avg(size_avg) OVER d, 6) AS size_avg
  FROM hourly WINDOW d AS (PARTITION BY disk_id)""",
)
def mean_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ch.normalise(hourly(spark, folder).drop("size_p90"), ["num_io", "size_avg"], "avg", ["disk_id"]))


@query(
    "ag18_radar_table",
    with_views(TRACE, _HOURLY)
    + """ SELECT disk_id % 4 AS type, disk_id, window_id, round(num_io / (1.25 * max(num_io) OVER t), 6) AS num_io,
    round(size_avg / (1.25 * max(size_avg) OVER t), 6) AS size_avg, round(size_p90 / (1.25 * max(size_p90) OVER t), 6) AS size_p90
  FROM hourly WINDOW t AS (PARTITION BY disk_id % 4)""",
)
def radar_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = hourly(spark, folder).withColumn("type", F.col("disk_id") % 4)
    return rounded(ch.normalise(rows, ["num_io", "size_avg", "size_p90"], "max", ["type"], padding=1.25))


@query(
    "ag20_groups_larger_than",
    with_views(TRACE) + f" SELECT event_id, disk_id FROM (SELECT *, count(*) OVER (PARTITION BY disk_id, floor(ts_record / {HOUR_MS})) AS n FROM trace) WHERE n > 3",
)
def groups_larger_than(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.trace(spark, folder).withColumn("window_id", F.floor(F.col("ts_record") / HOUR_MS))
    return sampling.groups_larger_than(rows, ["disk_id", "window_id"], 3).select("event_id", "disk_id")


_CORR = ("latency", "size", "offset", "ts_record")


@query(
    "ag22_correlations",
    with_views(TRACE, REPLAYED)
    + " "
    + " UNION ALL ".join(f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr("{a}", "{b}"), 6) AS corr FROM replayed""" for a in _CORR for b in _CORR),
)
def correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.correlations(fixtures.replayed(spark, folder), _CORR))


@query(
    "ag23_nested_means",
    with_views(TRACE, PREDICTION)
    + """, r AS (SELECT model, window_id, row_id % 4 AS size, row_id % 3 AS repetition, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM prediction GROUP BY ALL),
  w AS (SELECT size, window_id, avg(accuracy) AS accuracy FROM r GROUP BY ALL)
  SELECT size, round(avg(accuracy), 6) AS accuracy FROM w GROUP BY 1""",
)
def nested_means(spark: SparkSession, folder: str) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    rows = fixtures.prediction(spark, folder).withColumns({"size": F.col("row_id") % 4, "repetition": F.col("row_id") % 3})
    runs = rows.groupBy("model", "window_id", "size", "repetition").agg(F.avg(hit).alias("accuracy"))
    return rounded(ev.nested_means(runs, ["size", "window_id"], ["size"], ["accuracy"]))


@query(
    "ag25_scaled_features",
    with_views(TRACE, REPLAYED)
    + """ SELECT event_id, round((latency - m) / greatest(s, 1e-7), 6) AS latency, round((size - m2) / greatest(s2, 1e-7), 6) AS size
  FROM replayed, (SELECT avg(latency) AS m, stddev_samp(latency) AS s, avg(size) AS m2, stddev_samp(size) AS s2 FROM replayed)""",
)
def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.replayed(spark, folder).select("event_id", "latency", "size")
    return rounded(ev.apply_scaler(rows, ev.fit_scaler(rows, ["latency", "size"]), ["latency", "size"]))


@query(
    "ag26_describe",
    with_views(TRACE, REPLAYED)
    + """ SELECT chunk, count(latency) AS count, round(avg(latency), 4) AS mean, round(stddev_samp(latency), 4) AS std, min(latency)::DOUBLE AS min, max(latency)::DOUBLE AS max,
    round(quantile_cont(latency, 0.25), 4) AS p25, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.75), 4) AS p75 FROM replayed GROUP BY 1""",
)
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(describe_column(fixtures.replayed(spark, folder), ["chunk"], F.col("latency")), 4)


