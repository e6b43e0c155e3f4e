"""Drift series, concept ends, pairs and drifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import drift
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import HOUR_MS, SERIES, TRACE, with_views

# the hourly counts move little, so groups are 2 wide and concepts 5 rows long
SETTINGS = drift.DriftSettings(threshold=2, offset=2, stability=5)
LONG = drift.DriftSettings(threshold=4, offset=4, stability=5)


def series(spark: SparkSession, folder: str) -> DataFrame:
    return drift.index_series(fixtures.series(spark, folder), "hour")


def _grouped(s: drift.DriftSettings) -> str:
    return f"""g AS (SELECT *, CASE WHEN value < 0 THEN 0 WHEN value - 1 <= {s.offset} THEN 1
    ELSE CAST(trunc((value - {s.offset}) / {s.threshold}.0) AS INTEGER) + 2 END AS "group" FROM series)"""


def _rows(s: drift.DriftSettings) -> str:
    """Histograms, modes and both stability counts."""
    w, half = s.window, s.window // 2
    return f"""h AS (SELECT *, list("group") OVER (ORDER BY idx ROWS BETWEEN {w} PRECEDING AND CURRENT ROW) AS behind,
    list("group") OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS front, lag("group") OVER (ORDER BY idx) AS prev_group FROM g),
m AS (SELECT idx, v AS mode FROM (SELECT idx, unnest(behind) AS v FROM h) GROUP BY idx, v QUALIFY row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, v) = 1),
o AS (SELECT *, len(list_filter(behind, lambda x: x = "group")) AS own, len(list_filter(front, lambda x: x = "group")) AS ahead,
    len(list_filter(behind, lambda x: x <> "group" AND abs(x - "group") <= 2)) AS near FROM h),
f AS (SELECT *, prev_group IS NULL OR NOT (len(behind) < {w} OR (own > {half} AND ahead > {half})
    OR coalesce(lag(own) OVER (ORDER BY idx), 0) > {half} OR near > {half}) AS reset, prev_group IS NULL OR "group" <> prev_group AS turn FROM o),
rows AS (SELECT series, idx, value, "group", behind, front, mode,
    idx - max(CASE WHEN reset THEN idx END) OVER (ORDER BY idx) AS stability,
    idx - max(CASE WHEN turn THEN idx END) OVER (ORDER BY idx) AS stability_group FROM f JOIN m USING (idx)),
ends AS (SELECT * FROM (SELECT *, lead(stability) OVER (ORDER BY idx) AS nxt FROM rows) WHERE stability >= {s.stability} AND nxt = 0),
pairs AS (SELECT a.idx AS start_idx, b.idx AS end_idx FROM ends a JOIN ends b ON a.idx < b.idx AND b.idx - (a.idx - a.stability) < {s.reach})"""


# row-by-row reading of the definition: every lookup scans the series
_LAST = "(SELECT max(idx) FROM rows)"


def _nearest_before(at: str, grp: str) -> str:
    return f'coalesce((SELECT max(z.idx) FROM rows z WHERE z.idx <= {at} AND z.idx >= 1 AND z."group" = {grp}), {at})'


def _run_start(at: str, grp: str) -> str:
    return f'coalesce((SELECT max(z.idx) FROM edges z WHERE z.idx <= {at} AND z.idx >= 1 AND z."group" = {grp} AND z.prev <> {grp}), {at})'


def _run_end(at: str, grp: str) -> str:
    return f'coalesce((SELECT min(z.idx) FROM edges z WHERE z.idx >= {at} AND z."group" = {grp} AND z.nxt <> {grp}), {at})'


_EDGES = 'edges AS (SELECT idx, "group", lag("group") OVER (ORDER BY idx) AS prev, lead("group") OVER (ORDER BY idx) AS nxt FROM rows)'
_REFINED = f"""near1 AS (SELECT p.*, s.mode AS m, s."group" AS sg, s.idx - s.stability AS origin, {_nearest_before("p.start_idx", "s.mode")} AS near
  FROM pairs p JOIN rows s ON s.idx = p.start_idx),
refined AS (SELECT start_idx, end_idx, start, r.mode AS start_mode, e."group" AS end_group, e.mode AS end_mode FROM (
    SELECT n.*, CASE WHEN b."group" = m THEN origin WHEN sg <> m THEN {_run_start("n.near", "n.m")} ELSE start_idx END AS start
    FROM near1 n JOIN rows b ON b.idx = n.origin) x JOIN rows r ON r.idx = x.start JOIN rows e ON e.idx = x.end_idx)"""
_MASS = "mass AS (SELECT r.idx, q.mode, len(list_filter(r.behind, lambda x: abs(x - q.mode) <= 1)) AS mass FROM rows r, (SELECT DISTINCT mode FROM rows) q)"


def _recurring(s: drift.DriftSettings) -> str:
    return f"""same AS (SELECT p.*, count(*) FILTER (WHERE c.mass < {s.window // 2}) AS away_rows FROM refined p
  LEFT JOIN mass c ON c.mode = p.start_mode AND c.idx > p.start AND c.idx < p.end_idx WHERE p.start_mode = p.end_mode GROUP BY ALL),
back AS (SELECT *, CASE WHEN end_group <> start_mode THEN {_nearest_before("t.end_idx", "t.start_mode")} ELSE end_idx END AS at FROM same t WHERE away_rows > {s.recurring_rows}),
recurring AS (SELECT 'num_io' AS series, start_idx, end_idx, start, {_run_end("k.at", "k.start_mode")} AS "end", start_mode, end_mode, away_rows FROM back k)"""


def _shifts(s: drift.DriftSettings) -> str:
    return f"""heavy AS (SELECT p.start_idx, p.end_idx, c.idx, c.idx - 1 - lag(c.idx) OVER (PARTITION BY p.start_idx, p.end_idx ORDER BY c.idx) AS gap
  FROM refined p JOIN mass c ON c.mode = p.end_mode AND c.idx > p.start_idx AND c.idx < p.end_idx
  WHERE abs(p.start_mode - p.end_mode) > 1 AND c.mass >= {s.window // 2}),
broken AS (SELECT start_idx, end_idx, count(*) FILTER (WHERE gap > {s.window}) > 0 AS is_gradual FROM heavy GROUP BY ALL),
shifts AS (SELECT 'num_io' AS series, start_idx, end_idx, {_run_start("p.start", "p.start_mode")} AS start, {_run_end("p.end_idx", "p.end_mode")} AS "end",
  start_mode, end_mode, coalesce(is_gradual, FALSE) AS is_gradual FROM refined p LEFT JOIN broken USING (start_idx, end_idx) WHERE abs(start_mode - end_mode) > 1),
typed AS (SELECT *, CASE WHEN is_gradual THEN 'gradual' WHEN abs(start_mode - end_mode) > CASE WHEN start_mode = 0 OR end_mode = 0 THEN 2 ELSE 1 END THEN 'sudden' ELSE 'incremental' END AS type FROM shifts),
drifts AS (SELECT series, start, "end", 'recurring' AS type, start_mode, end_mode FROM recurring
  UNION ALL SELECT series, start, "end", type, start_mode, end_mode FROM typed WHERE type <> 'sudden' OR start NOT IN (SELECT start FROM recurring))"""


def _sql(s: drift.DriftSettings, *more: str) -> str:
    return with_views(TRACE, SERIES, _grouped(s), _rows(s), *more)


def rows_of(spark: SparkSession, folder: str, settings: drift.DriftSettings = SETTINGS) -> DataFrame:
    return drift.stability(series(spark, folder), settings)


def refined_of(spark: SparkSession, folder: str, settings: drift.DriftSettings) -> tuple[DataFrame, DataFrame, drift.RunIndex]:
    from spindle.session import stable

    rows = stable(rows_of(spark, folder, settings))
    runs = drift.RunIndex.of(rows)
    pairs = drift.candidate_pairs(drift.concept_ends(rows, settings), settings)
    return stable(drift.refine_pairs(pairs, rows, runs)), rows, runs


@query("dr1_value_groups", _sql(SETTINGS) + ' SELECT idx, value, "group" FROM g')
def groups(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", "value", "group")


@query("wf8_trailing_histogram", _sql(SETTINGS) + ' SELECT idx, list_sort(behind) AS "trailing" FROM rows')
def trailing(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", F.array_sort("trailing").alias("trailing"))


@query(
    "wf8_histogram_counts",
    _sql(SETTINGS) + ' SELECT idx, v AS "group", count(*) AS n FROM (SELECT idx, unnest(behind) AS v FROM rows) GROUP BY ALL',
)
def histogram_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = rows_of(spark, folder).select("idx", F.explode(drift.histogram(F.col("trailing"))).alias("group", "n"))
    return rows.withColumn("n", F.col("n").cast("long"))


@query("wf9_leading_histogram", _sql(SETTINGS) + ' SELECT idx, list_sort(front) AS "leading" FROM rows')
def leading(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", F.array_sort("leading").alias("leading"))


@query("wf10_highest_mode", _sql(SETTINGS) + " SELECT idx, mode FROM rows")
def modes(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", "mode")


@query(
    "wf11_similar_mass",
    _sql(SETTINGS) + """ SELECT idx, len(list_filter(behind, lambda x: abs(x - mode) <= 1)) AS around_mode, len(list_filter(behind, lambda x: x <> "group" AND abs(x - "group") <= 2)) AS around_group FROM rows""",
)
def similar(spark: SparkSession, folder: str) -> DataFrame:
    around = drift.similar_mass(F.col("trailing"), F.col("mode"), 1).cast("long").alias("around_mode")
    return rows_of(spark, folder).select("idx", around, drift.similar_mass(F.col("trailing"), F.col("group"), 2, False).cast("long").alias("around_group"))


@query("wf12_stability", _sql(SETTINGS) + " SELECT idx, stability FROM rows")
def stability(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", "stability")


@query("wf13_stability_of_group", _sql(SETTINGS) + " SELECT idx, stability_group FROM rows")
def stability_group(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spark, folder).select("idx", "stability_group")


@query("dr2_concept_ends", _sql(LONG) + " SELECT idx, stability, mode FROM ends")
def concept_ends(spark: SparkSession, folder: str) -> DataFrame:
    return drift.concept_ends(rows_of(spark, folder, LONG), LONG).select("idx", "stability", "mode")


@query("jn4_candidate_pairs", _sql(LONG) + " SELECT 'num_io' AS series, start_idx, end_idx FROM pairs")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return drift.candidate_pairs(drift.concept_ends(rows_of(spark, folder, LONG), LONG), LONG)


SHORT = drift.DriftSettings(threshold=4, offset=4, stability=5, reach=100)


@query("dr3_candidate_pairs_in_reach", _sql(SHORT) + " SELECT 'num_io' AS series, start_idx, end_idx FROM pairs")
def candidate_pairs_in_reach(spark: SparkSession, folder: str) -> DataFrame:
    return drift.candidate_pairs(drift.concept_ends(rows_of(spark, folder, SHORT), SHORT), SHORT)


_PROBES = """probes AS (SELECT r.idx, r.idx % 17 + 1 AS grp FROM rows r)"""


@query(
    "jn5_nearest_rows",
    with_views(TRACE, SERIES, _grouped(SETTINGS), _rows(SETTINGS), _EDGES, _PROBES)
    + f""" SELECT idx, CAST(grp AS INTEGER) AS wanted, {_nearest_before("p.idx", "p.grp")} AS before,
    coalesce((SELECT min(z.idx) FROM rows z WHERE z.idx > p.idx AND z.idx < {_LAST} AND z."group" = p.grp), p.idx) AS after,
    {_run_start("p.idx", "p.grp")} AS run_start, {_run_end("p.idx", "p.grp")} AS run_end FROM probes p""",
)
def nearest_rows(spark: SparkSession, folder: str) -> DataFrame:
    from spindle.session import stable

    rows = stable(rows_of(spark, folder))
    runs = drift.RunIndex.of(rows)
    probes = rows.select("series", "idx", (F.col("idx") % 17 + 1).cast("int").alias("wanted"))
    found = runs.nearest_before(probes, "idx", "wanted", "before")
    found = runs.nearest_after(found, "idx", "wanted", "after")
    found = runs.run_start_before(found, "idx", "wanted", "run_start")
    return runs.run_end_after(found, "idx", "wanted", "run_end").drop("series")


@query("dr4_refined_pairs", _sql(LONG, _EDGES, _REFINED) + " SELECT 'num_io' AS series, start_idx, end_idx, start, start_mode, end_group, end_mode FROM refined")
def refined_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return refined_of(spark, folder, LONG)[0]


@query("dr5_recurring", _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS)) + " SELECT * FROM recurring")
def recurring(spark: SparkSession, folder: str) -> DataFrame:
    pairs, rows, runs = refined_of(spark, folder, SETTINGS)
    return drift.recurring_drifts(pairs, drift.similar_rows(rows, SETTINGS), runs, SETTINGS)


@query("dr6_gradual", _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS), _shifts(SETTINGS)) + " SELECT * FROM shifts")
def gradual(spark: SparkSession, folder: str) -> DataFrame:
    pairs, rows, runs = refined_of(spark, folder, SETTINGS)
    return drift.shifting_pairs(pairs, drift.similar_rows(rows, SETTINGS), runs, SETTINGS)


@query(
    "dr7_merged_intervals",
    with_views(TRACE)
    + f""", i AS (SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS start, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) + size // 8192 AS "end" FROM trace),
  p AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY disk_id ORDER BY start, "end")),
  c AS (SELECT *, sum(fresh) OVER (PARTITION BY disk_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS piece FROM p)
  SELECT disk_id, min(start) AS start, arg_max("end", start * 1000 + "end" - start) AS "end", count(*) AS n FROM c GROUP BY disk_id, piece""",
)
def merged_intervals(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.floor(F.col("ts_record") / HOUR_MS).cast("long")
    rows = fixtures.trace(spark, folder).select("disk_id", hour.alias("start"), (hour + F.floor(F.col("size") / 8192)).cast("long").alias("end"))
    return drift.merge_intervals(rows, ["disk_id"], 2)


DRIFT_SQL = _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS), _shifts(SETTINGS))


@query("dr8_drifts", _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS), _shifts(SETTINGS)) + " SELECT * FROM drifts")
def drifts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.find_drifts(series(spark, folder), SETTINGS)


@query("dr8_drifts_wide_groups", _sql(LONG, _EDGES, _REFINED, _MASS, _recurring(LONG), _shifts(LONG)) + " SELECT * FROM drifts")
def drifts_wide_groups(spark: SparkSession, folder: str) -> DataFrame:
    return drift.find_drifts(series(spark, folder), LONG)


@query(
    "dr9_mode_trend",
    _sql(SETTINGS, _EDGES, _REFINED)
    + """, y AS (SELECT start_idx, end_idx, start_mode, end_mode, (r.idx - start_idx - 1)::DOUBLE AS x, len(list_filter(r.behind, lambda q: q = start_mode))::DOUBLE AS y
    FROM refined JOIN rows r ON r.idx > start_idx AND r.idx <= end_idx),
  s AS (SELECT start_idx, end_idx, start_mode, end_mode, count(*) AS rows, regr_slope(y, x) AS slope FROM y GROUP BY ALL)
  SELECT 'num_io' AS series, start_idx, end_idx, start_mode, end_mode, rows, round(slope, 6) AS slope,
    coalesce(abs(slope) >= 0.01 AND CASE WHEN start_mode < end_mode THEN slope <= 0 ELSE slope >= 0 END, FALSE) AS is_trend FROM s""",
)
def mode_trend(spark: SparkSession, folder: str) -> DataFrame:
    pairs, rows, _ = refined_of(spark, folder, SETTINGS)
    return rounded(drift.mode_trend(pairs, rows))


@query(
    "dr13_sliced_series",
    _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS), _shifts(SETTINGS))
    + """ SELECT type, start, "end", idx, value FROM (SELECT DISTINCT type, start, "end" FROM drifts) d JOIN series s ON s.idx >= d.start AND s.idx < d."end" """,
)
def sliced(spark: SparkSession, folder: str) -> DataFrame:
    rows = series(spark, folder)
    found = drift.find_drifts(rows, SETTINGS).select("series", "type", "start", "end").distinct()
    return drift.slice_drifts(rows, found).select("type", "start", "end", "idx", "value")


@query(
    "jn3_rows_of_selected_drifts",
    _sql(SETTINGS, _EDGES, _REFINED, _MASS, _recurring(SETTINGS), _shifts(SETTINGS))
    + """ SELECT type, start, "end", idx, value FROM (SELECT DISTINCT type, start, "end" FROM drifts) d JOIN series s ON s.idx BETWEEN d.start AND d."end" WHERE start % 2 = 0""",
)
def rows_of_selected(spark: SparkSession, folder: str) -> DataFrame:
    rows = series(spark, folder)
    listed = drift.selected_drifts(drift.find_drifts(rows, SETTINGS)).distinct()
    chosen = listed.withColumn("should_use", F.when(F.col("start") % 2 == 0, "y").otherwise("n")).where(F.col("should_use") == "y")
    return drift.slice_drifts(rows, chosen, closed=True).select("type", "start", "end", "idx", "value")


# --- first version ---------------------------------------------------------------------------------------------

FIRST = drift.DriftSettings(threshold=2, offset=2, stability=5, min_length=8)


def _rows_v1(s: drift.DriftSettings) -> str:
    w = s.window
    return f"""h AS (SELECT *, list("group") OVER b AS behind, list("group") OVER a AS front, min("group") OVER b AS min_group, max("group") OVER b AS max_group,
    lag("group") OVER (ORDER BY idx) AS prev_group FROM g WINDOW b AS (ORDER BY idx ROWS BETWEEN {w} PRECEDING AND CURRENT ROW), a AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING)),
m AS (SELECT idx, v AS mode FROM (SELECT idx, unnest(behind) AS v FROM h) GROUP BY idx, v QUALIFY row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, v) = 1),
n AS (SELECT idx, v AS next_mode FROM (SELECT idx, unnest(front) AS v FROM h) GROUP BY idx, v QUALIFY row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, v) = 1),
p AS (SELECT *, lag(mode) OVER (ORDER BY idx) AS prev_mode FROM h JOIN m USING (idx) JOIN n USING (idx)),
rows AS (SELECT series, idx, value, "group", mode, next_mode, min_group, max_group,
    coalesce(max(CASE WHEN mode < prev_mode THEN idx - 1 END) OVER o, -1) AS increasing_idx, coalesce(max(CASE WHEN mode > prev_mode THEN idx - 1 END) OVER o, -1) AS decreasing_idx,
    idx - max(CASE WHEN prev_mode IS NULL OR mode <> prev_mode THEN idx END) OVER o AS stability,
    idx - max(CASE WHEN prev_group IS NULL OR "group" <> prev_group THEN idx END) OVER o AS stability_group FROM p WINDOW o AS (ORDER BY idx))"""


_V1 = with_views(TRACE, SERIES, _grouped(FIRST), _rows_v1(FIRST))


@query("wf14_mode_markers", _V1 + " SELECT * FROM rows")
def mode_markers(spark: SparkSession, folder: str) -> DataFrame:
    return drift.stability_v1(series(spark, folder), FIRST)


@query(
    "dr12_turn_counts",
    _V1
    + """ SELECT series, count(*) FILTER (WHERE increasing_idx <> pi) AS increasing_drifts, count(*) FILTER (WHERE increasing_idx = pi AND decreasing_idx <> pd) AS decreasing_drifts
  FROM (SELECT *, lag(increasing_idx) OVER (ORDER BY idx) AS pi, lag(decreasing_idx) OVER (ORDER BY idx) AS pd FROM rows) GROUP BY 1""",
)
def turn_counts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.count_turns(drift.stability_v1(series(spark, folder), FIRST))


@query(
    "wf23_monotone_test",
    _V1
    + """, pr AS (SELECT idx AS a, idx + 1 + idx % 4 AS b FROM rows WHERE idx + 1 + idx % 4 <= (SELECT max(idx) FROM rows)),
  st AS (SELECT idx, mode, lag(mode) OVER (ORDER BY idx) AS prev FROM rows),
  f AS (SELECT a, b, min(st.idx) FILTER (mode <= prev) AS first FROM pr JOIN st ON st.idx > a AND st.idx <= b GROUP BY ALL)
  SELECT a, b, first IS NULL AS is_increasing, coalesce(bool_and(mode < prev) FILTER (st.idx > first), TRUE) AS is_decreasing
  FROM f JOIN st ON st.idx > a AND st.idx <= b GROUP BY a, b, first""",
)
def monotone_test(spark: SparkSession, folder: str) -> DataFrame:
    from spindle.session import stable

    rows = stable(drift.stability_v1(series(spark, folder), FIRST))
    last = F.broadcast(rows.agg(F.max("idx").alias("_last")))  # one row
    pairs = rows.select("series", F.col("idx").alias("a"), (F.col("idx") + 1 + F.col("idx") % 4).alias("b")).join(last).where(F.col("b") <= F.col("_last"))
    return drift.monotone_between(pairs.drop("_last"), rows, "a", "b").drop("series")


_V1_DRIFTS = f"""edges AS (SELECT idx, "group", lag("group") OVER (ORDER BY idx) AS prev, lead("group") OVER (ORDER BY idx) AS nxt FROM rows),
ends AS (SELECT * FROM (SELECT *, lead(stability) OVER (ORDER BY idx) AS nx FROM rows) WHERE stability >= {FIRST.stability} AND nx = 0),
st AS (SELECT e.idx AS end_a, {_run_start("o.idx", 'o."group"')} AS start FROM ends e JOIN rows o ON o.idx = e.idx - e.stability),
cand AS (SELECT DISTINCT st.start, e.idx AS end_idx, s.mode AS start_mode, s."group" AS start_group, e.mode AS end_mode, e."group" AS end_group
  FROM st JOIN ends e ON e.idx > st.end_a JOIN rows s ON s.idx = st.start WHERE e.idx - st.start >= {FIRST.min_length}),
same AS (SELECT *, CASE WHEN start_group = end_group THEN end_idx ELSE (SELECT max(z.idx) FROM rows z WHERE z.idx >= c.start AND z.idx < c.end_idx AND z.stability > 0
    AND z."group" = c.start_group AND z.stability_group > {FIRST.stability}) END AS "end" FROM cand c WHERE start_mode = end_mode),
rec AS (SELECT start, "end", end_idx AS seen FROM same WHERE "end" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY start ORDER BY end_idx) = 1),
steps AS (SELECT idx, mode, lag(mode) OVER (ORDER BY idx) AS prev FROM rows),
oth AS (SELECT c.*, coalesce(bool_and(s.mode < s.prev) FILTER (s.idx > c.first), TRUE) AS steady
  FROM (SELECT c.*, min(s.idx) FILTER (s.mode <= s.prev) AS first FROM cand c JOIN steps s ON s.idx > c.start AND s.idx <= c.end_idx WHERE start_mode <> end_mode GROUP BY ALL) c
  JOIN steps s ON s.idx > c.start AND s.idx <= c.end_idx GROUP BY ALL),
found AS (SELECT start, "end", 'recurring' AS type FROM rec UNION ALL SELECT start, end_idx, 'incremental' FROM oth WHERE steady
  UNION ALL SELECT o.start, {_run_end("o.end_idx", "o.end_group")}, 'sudden' FROM oth o LEFT JOIN rec r ON r.start = o.start
    WHERE NOT steady AND abs(end_group - start_group) >= 2 AND (r.seen IS NULL OR r.seen > o.end_idx))"""


@query("dr10_first_version", with_views(TRACE, SERIES, _grouped(FIRST), _rows_v1(FIRST), _V1_DRIFTS) + """ SELECT 'num_io' AS series, start, "end", type FROM found""")
def first_version(spark: SparkSession, folder: str) -> DataFrame:
    return drift.find_drifts_v1(series(spark, folder), FIRST)


@query(
    "dr11_repeated_dropped",
    with_views(TRACE, SERIES, _grouped(FIRST), _rows_v1(FIRST), _V1_DRIFTS)
    + """ SELECT 'num_io' AS series, start, "end", type FROM (SELECT *, lead(start) OVER w AS ns, lead(type) OVER w AS nt FROM found WINDOW w AS (ORDER BY start, "end", type))
  WHERE NOT coalesce(ns = start AND nt = type, FALSE)""",
)
def repeated_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drop_repeated(drift.find_drifts_v1(series(spark, folder), FIRST))


# --- trends ----------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = rows_of(spark, folder)
    return rows.select("series", F.floor(F.col("idx") / 60).alias("segment"), "idx", "mode")


_SEGMENTS = 'seg AS (SELECT CAST(floor(idx / 60) AS BIGINT) AS segment, idx, mode FROM rows)'


@query(
    "dr14_tolerant_trend",
    _sql(SETTINGS, _SEGMENTS)
    + """, d AS (SELECT *, mode - lag(mode) OVER (PARTITION BY segment ORDER BY idx) AS step FROM seg),
  e AS (SELECT segment, count(*) AS rows, arg_min(mode, idx) AS first_mode, arg_max(mode, idx) AS last_mode, min(step) AS down, max(step) AS up FROM d GROUP BY 1)
  SELECT 'num_io' AS series, segment, rows, first_mode, last_mode,
    rows >= 2 AND first_mode <> last_mode AND CASE WHEN first_mode < last_mode THEN down >= -1 ELSE up <= 1 END AS is_incremental FROM e""",
)
def tolerant_trend(spark: SparkSession, folder: str) -> DataFrame:
    return drift.tolerant_trend(segments(spark, folder), ["series", "segment"], "idx", "mode")


@query(
    "dr15_many_series",
    with_views(TRACE)
    + f""", c AS (SELECT disk_id, CAST(floor(ts_record / {HOUR_MS}) AS BIGINT) AS window_id, CAST(count(*) AS DOUBLE) AS num_io, avg(size) AS size_avg FROM trace GROUP BY ALL),
  l AS (SELECT disk_id || '/' || metric AS series, window_id, value FROM c UNPIVOT (value FOR metric IN (num_io, size_avg)))
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY window_id) - 1 AS idx, round(value, 6) AS value FROM l""",
)
def many_series(spark: SparkSession, folder: str) -> DataFrame:
    window = F.floor(F.col("ts_record") / HOUR_MS).alias("window_id")
    rows = fixtures.trace(spark, folder).groupBy("disk_id", window).agg(F.count(F.lit(1)).cast("double").alias("num_io"), F.avg("size").alias("size_avg"))
    return rounded(drift.long_series(rows, ["disk_id"], "window_id", ["num_io", "size_avg"]))


@query(
    "dr16_mann_kendall",
    _sql(SETTINGS, _SEGMENTS)
    + """, s AS (SELECT a.segment, CAST(sum(sign(b.mode - a.mode)) AS BIGINT) AS s FROM seg a JOIN seg b ON a.segment = b.segment AND a.idx < b.idx GROUP BY 1),
  t AS (SELECT segment, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT segment, mode, count(*) AS c FROM seg GROUP BY ALL) GROUP BY 1),
  z AS (SELECT segment, CAST(n AS BIGINT) AS rows, s, coalesce((s - sign(s)) / nullif(sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18), 0), 0) AS z FROM s JOIN t USING (segment)),
  k AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
  p AS (SELECT *, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS p FROM k)
  SELECT 'num_io' AS series, segment, rows, s, round(z, 6) AS z, round(p, 6) AS p,
    CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 AND z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend FROM p""",
)
def mann_kendall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(drift.mann_kendall(segments(spark, folder), ["series", "segment"], "idx", "mode"))


@query("dr17_trending_segments")
def trending_segments(spark: SparkSession, folder: str) -> DataFrame:
    return drift.trending_segments(rows_of(spark, folder).select("series", "idx", "mode"), min_length=8)
