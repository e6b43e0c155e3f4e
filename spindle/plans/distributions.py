"""Distribution functions, densities and knees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import distribution as ds
from spindle.operators import drift
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import REPLAYED, SERIES, TRACE, with_views

_R = with_views(TRACE, REPLAYED)


@query(
    "ds1_ecdf",
    _R + " SELECT DISTINCT disk_id, latency::DOUBLE AS x, round(cume_dist() OVER (PARTITION BY disk_id ORDER BY latency), 9) AS y FROM replayed",
)
def ecdf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.ecdf(fixtures.replayed(spark, folder), ["disk_id"], F.col("latency")), 9)


@query(
    "ds2_rank_ecdf",
    _R
    + """ SELECT disk_id, latency::DOUBLE AS x, count(*) AS n, round(avg(r) / any_value(total), 9) AS y FROM (
    SELECT disk_id, latency, row_number() OVER (PARTITION BY disk_id ORDER BY latency) AS r, count(*) OVER (PARTITION BY disk_id) AS total FROM replayed) GROUP BY ALL""",
)
def rank_ecdf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.rank_ecdf(fixtures.replayed(spark, folder), ["disk_id"], F.col("latency")), 9)


def _sampled_sql(keys: str, low: float, high: float, step: float) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f""", c AS (SELECT DISTINCT {lead}latency::DOUBLE AS x, cume_dist() OVER ({by} ORDER BY latency) AS y FROM keyed),
  i AS (SELECT * FROM c WHERE y >= {low} AND y <= {high}),
  s AS (SELECT *, row_number() OVER (PARTITION BY {lead}floor((y - {low}::DOUBLE) / {step}::DOUBLE) ORDER BY x) AS first, row_number() OVER ({by} ORDER BY x DESC) AS last FROM i)
  SELECT {lead}x, round(y, 9) AS y FROM s WHERE first = 1 OR last = 1"""


@query("ds3_sampled_cdf", with_views(TRACE, REPLAYED, "keyed AS (SELECT * FROM replayed)") + _sampled_sql("", 0.1, 0.95, 0.003))
def sampled_cdf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.sampled_cdf(fixtures.replayed(spark, folder), [], F.col("latency"), 0.1, 0.95, 0.003), 9)


_KEYED = """keyed AS (SELECT latency, ['sudden', 'gradual', 'recurring'][CAST(chunk % 3 + 1 AS INTEGER)] AS type,
  (chunk // 5 * 5) || '_' || (chunk // 5 * 5 + 5) AS start_end FROM replayed)"""


@query("ds4_cdf_per_drift", with_views(TRACE, REPLAYED, _KEYED) + _sampled_sql("type, start_end", 0.0, 1.0, 0.01))
def cdf_per_drift(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("sudden"), F.lit("gradual"), F.lit("recurring")), (F.col("chunk") % 3 + 1).cast("int"))
    start = F.floor(F.col("chunk") / 5) * 5
    rows = fixtures.replayed(spark, folder).select("latency", kind.alias("type"), F.concat(start, F.lit("_"), start + 5).alias("start_end"))
    return rounded(ds.sampled_cdf(rows, ["type", "start_end"], F.col("latency"), precision=0.01), 9)


def _density_sql(keys: str) -> str:
    by, lead = (f"GROUP BY {keys}", f"{keys}, ") if keys else ("", "")
    join = f"JOIN s USING ({keys})" if keys else "CROSS JOIN s"
    return f""", s AS (SELECT {lead}count(*) AS n, 1.06::DOUBLE * stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h FROM d {by}),
  k AS (SELECT {lead}g AS point, g * 0.1::DOUBLE AS grid, abs(g * 0.1::DOUBLE - x) / h / sqrt(2) AS u, n, h FROM d {join}, (SELECT unnest(range(201)) AS g)),
  pdf AS (SELECT {lead}point, round(grid, 6) AS grid, sum(0.5::DOUBLE * exp(-u) * sin(u + pi() / 4)) / any_value(n) / any_value(h) AS pdf FROM k GROUP BY ALL)"""


_SCALED = "d AS (SELECT chunk, size / 2500.0::DOUBLE AS x FROM replayed)"


@query("ds5_density", with_views(TRACE, REPLAYED, _SCALED) + _density_sql("") + " SELECT point, grid, round(pdf, 6) AS pdf FROM pdf")
def density(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.density(fixtures.replayed(spark, folder), [], F.col("size") / 2500.0))


_AT_POINTS = """, s AS (SELECT chunk, count(*) AS n, 1.06::DOUBLE * stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h FROM d GROUP BY chunk),
  k AS (SELECT chunk, p.x, (p.x - d.x) / h / sqrt(2) AS u, n, h FROM (SELECT DISTINCT chunk, x FROM d) p JOIN d USING (chunk) JOIN s USING (chunk))
  SELECT chunk, round(x, 6) AS x, round(sum(0.5::DOUBLE * exp(-abs(u)) * sin(abs(u) + pi() / 4)) / any_value(n) / any_value(h), 6) AS pdf,
    round(avg(CASE WHEN u >= 0 THEN 1 - 0.5::DOUBLE * exp(-u) * cos(u) ELSE 0.5::DOUBLE * exp(u) * cos(u) END), 6) AS cdf FROM k GROUP BY chunk, x"""


@query("ds5_density_at_points", with_views(TRACE, REPLAYED, "d AS (SELECT chunk, latency / 100.0::DOUBLE AS x FROM replayed)") + _AT_POINTS)
def density_at_points(spark: SparkSession, folder: str) -> DataFrame:
    """Density and its integral at every value, per window."""
    found = ds.densities(fixtures.replayed(spark, folder), ["chunk"], F.col("latency") / 100.0)
    return rounded(found.select("chunk", "x", "pdf", "cdf"))


@query(
    "ds6_density_cdf",
    with_views(TRACE, REPLAYED, _SCALED) + _density_sql("") + " SELECT point, grid, round(sum(pdf) OVER (ORDER BY point) * 0.1, 6) AS cdf FROM pdf",
)
def density_cdf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.density_cdf(ds.density(fixtures.replayed(spark, folder), [], F.col("size") / 2500.0), []))


@query(
    "ds7_density_per_window",
    with_views(TRACE, REPLAYED, _SCALED) + _density_sql("chunk") + " SELECT chunk, point, grid, round(pdf, 6) AS pdf FROM pdf",
)
def density_per_window(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.density(fixtures.replayed(spark, folder), ["chunk"], F.col("size") / 2500.0))


@query(
    "ds8_ratio_to_previous",
    with_views(TRACE, SERIES)
    + """, v AS (SELECT *, value / avg(value) OVER () AS norm FROM series)
  SELECT series, idx, value AS real, round(norm, 6) AS norm, round(coalesce(value / nullif(lag(value) OVER o, 0), 0), 6) AS diff,
    round(coalesce(norm / nullif(lag(norm) OVER o, 0), 0), 6) AS diff_norm FROM v WINDOW o AS (ORDER BY idx)""",
)
def ratio_to_previous(spark: SparkSession, folder: str) -> DataFrame:
    rows = drift.index_series(fixtures.series(spark, folder), "hour")
    return rounded(ds.series_variants(rows, ["series"], "idx"))


_CURVE = """, q AS (SELECT chunk, 5 * quantile_cont(latency, 0.5) AS x_max, quantile_cont(latency, list_transform(range(1, 101), lambda i: i / 100)) AS x FROM replayed GROUP BY 1),
  c AS (SELECT chunk, x_max, p, round_even(x[p] * 100, 0) / 100 AS raw FROM q, (SELECT unnest(range(1, 101)) AS p))""".replace(
    "list_transform(range(1, 101), lambda i: i / 100)", "[" + ", ".join(f"{i / 100}" for i in range(1, 101)) + "]"
)


@query(
    "ds10_area_knee",
    _R
    + _CURVE
    + """, y AS (SELECT chunk, p, least(raw, x_max) AS x, p * x_max / 100 AS y, max(least(raw, x_max)) OVER (PARTITION BY chunk) AS top FROM c),
  seg AS (SELECT b.chunk, b.p, (a.y + b.y) * abs(b.x - a.x) / 2 AS down, (a.top - b.x + a.top - a.x) * abs(b.y - a.y) / 2 AS rgt
    FROM y b JOIN y a ON a.chunk = b.chunk AND a.p = b.p - 1),
  area AS (SELECT k.chunk, k.p, k.x, floor(coalesce(sum(down) FILTER (WHERE seg.p <= k.p + 1), 0)) AS d, floor(coalesce(sum(rgt) FILTER (WHERE seg.p > k.p), 0)) AS r
    FROM y k JOIN seg ON seg.chunk = k.chunk WHERE k.p BETWEEN 2 AND 99 GROUP BY ALL)
  SELECT chunk, x AS knee, p AS knee_percent FROM area QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY abs(d - r), p) = 1""",
)
def area_knee(spark: SparkSession, folder: str) -> DataFrame:
    return ds.area_knee(fixtures.replayed(spark, folder), ["chunk"], F.col("latency"))


@query(
    "ds11_area_left",
    _R
    + _CURVE
    + """ SELECT b.chunk, round(sum((a.raw + b.raw) / 2), 4) AS area FROM c b JOIN c a ON a.chunk = b.chunk AND a.p = b.p - 1 WHERE b.p <= 81 GROUP BY 1""",
)
def area_left(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ds.area_left_of(fixtures.replayed(spark, folder), ["chunk"], F.col("latency"), 80), 4)


_GAIN = """, f AS (SELECT chunk, latency::DOUBLE AS v, latency <= 600 AS ok FROM replayed WHERE io_type = 1),
  lim AS (SELECT chunk, greatest(3 * quantile_cont(v, 0.7), 1000) AS lim, count(*) AS n FROM f GROUP BY 1),
  raw AS (SELECT chunk, v, (row_number() OVER (PARTITION BY chunk ORDER BY v) - 1) / count(*) OVER (PARTITION BY chunk) AS y FROM f),
  best AS (SELECT chunk, v, (row_number() OVER (PARTITION BY chunk ORDER BY v) - 1) / count(*) OVER (PARTITION BY chunk) AS y FROM f WHERE ok),
  tops AS (SELECT chunk, max(v) AS top FROM raw JOIN lim USING (chunk) WHERE v < lim GROUP BY 1),
  padded AS (SELECT chunk, v, y FROM best JOIN lim USING (chunk) WHERE v < lim
    UNION ALL SELECT chunk, top, 1 FROM tops WHERE top > (SELECT max(v) FROM best b JOIN lim USING (chunk) WHERE b.chunk = tops.chunk AND v < lim)),
  a AS (SELECT chunk, sum(w) AS area FROM (SELECT chunk, (v - lag(v) OVER o) * (y + lag(y) OVER o) / 2 AS w FROM raw JOIN lim USING (chunk) WHERE v < lim
    WINDOW o AS (PARTITION BY chunk ORDER BY v, y)) GROUP BY 1),
  b AS (SELECT chunk, sum(w) AS area FROM (SELECT chunk, (v - lag(v) OVER o) * (y + lag(y) OVER o) / 2 AS w FROM padded
    WINDOW o AS (PARTITION BY chunk ORDER BY v, y)) GROUP BY 1)"""


@query(
    "ds12_cdf_gain",
    _R + _GAIN + " SELECT chunk, CASE WHEN n < 100 THEN '0%' ELSE CAST(round((b.area - a.area) * 100 / a.area, 2) AS VARCHAR) || '%' END AS cdf_gain FROM lim JOIN a USING (chunk) JOIN b USING (chunk)",
)
def cdf_gain(spark: SparkSession, folder: str) -> DataFrame:
    reads = fixtures.replayed(spark, folder).where(F.col("io_type") == 1)
    return ds.cdf_gain(reads, ["chunk"], F.col("latency"), F.col("latency") <= 600)


@query(
    "ds13_accepted_cdf",
    _R
    + """, f AS (SELECT disk_id, latency::DOUBLE AS x, (event_id * 37) % 1000 <= 500 AS ok FROM replayed),
  lim AS (SELECT disk_id, round(greatest(3 * quantile_cont(x, 0.7), 1000), 6) AS x_limit, CAST(floor(count(*) FILTER (WHERE NOT ok) * 100.0 / count(*)) AS BIGINT) AS percent_slow FROM f GROUP BY 1),
  c AS (SELECT disk_id, 'raw' AS kind, x, max(r - 1) / any_value(n) AS y FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY x) AS r, count(*) OVER (PARTITION BY disk_id) AS n FROM f) GROUP BY ALL
    UNION ALL SELECT disk_id, 'accepted', x, max(r - 1) / any_value(n) FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY x) AS r, count(*) OVER (PARTITION BY disk_id) AS n FROM f WHERE ok) GROUP BY ALL)
  SELECT disk_id, kind, x, round(y, 9) AS y, x_limit, percent_slow FROM c JOIN lim USING (disk_id)""",
)
def accepted_cdf(spark: SparkSession, folder: str) -> DataFrame:
    ok = (F.col("event_id") * 37) % 1000 <= 500
    return rounded(ds.accepted_cdf(fixtures.replayed(spark, folder), ["disk_id"], F.col("latency"), ok), {"y": 9})
