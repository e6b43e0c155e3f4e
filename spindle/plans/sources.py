"""Reading raw formats (the raw files are first derived from ``events``)."""

from __future__ import annotations

import io
import re
import tarfile
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.plans.registry import query, rounded
from spindle.session import scratch_path
from spindle.sources import fixtures, readers
from spindle.sources.fixtures import PREDICTION, REPLAYED, TRACE, with_views

_CANONICAL = ["ts_record", "disk_id", "offset", "size", "io_type"]
_TRACE_SQL = with_views(TRACE) + ' SELECT ts_record, disk_id, "offset", size, io_type FROM trace'


@query("src1_read_trace", _TRACE_SQL)
def read_trace(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "canonical")
    rows = fixtures.trace(spark, folder).select(*_CANONICAL)
    rows.write.option("sep", " ").option("compression", "gzip").csv(path)
    return readers.read_trace(spark, path)


@query("src1_read_archives", _TRACE_SQL)
def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Devices by turns in plain files, compressed archives and bare ones, all read from one list of paths."""
    path = scratch_path(spark, "mixed")
    rows = fixtures.trace(spark, folder).select(*_CANONICAL)
    rows.where("disk_id % 3 = 0").write.option("sep", " ").csv(f"{path}/plain")

    def pack(disk: pd.DataFrame) -> pd.DataFrame:
        device = int(disk["disk_id"].iloc[0])
        name = f"{path}/disk_{device}.{'tgz' if device % 3 == 1 else 'tar'}"
        where, inside = fs.FileSystem.from_uri(re.sub(r"^(file:/+|/)", "file:///", name))
        with where.open_output_stream(inside, compression=None) as file, tarfile.open(fileobj=file, mode="w|gz" if device % 3 == 1 else "w|") as archive:
            for n, part in enumerate((disk.iloc[::2], disk.iloc[1::2])):
                text = part.to_csv(sep=" ", header=False, index=False).encode()
                member = tarfile.TarInfo(f"trace/part_{n}.csv")
                member.size = len(text)
                archive.addfile(member, io.BytesIO(text))
        return pd.DataFrame({"name": [name]})

    packed = rows.where("disk_id % 3 <> 0").groupBy("disk_id").applyInPandas(pack, "name string")
    names = [r["name"] for r in packed.collect()]  # a few names; the files are written by the tasks
    return readers.read_trace(spark, [f"{path}/plain", *names])


def _raw_alibaba(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.trace(spark, folder).select(
        F.col("disk_id").cast("int").alias("device_id"),
        F.when(F.col("io_type") == 1, "R").otherwise("W").alias("opcode"),
        "offset",
        F.col("size").cast("int").alias("length"),
        F.floor(F.col("ts_record") * 1000).cast("long").alias("timestamp"),
    )


@query(
    "src2_read_alibaba",
    with_views(TRACE)
    + """ SELECT floor(ts_record * 1000) / 1000 AS ts_record, disk_id, "offset", size, io_type FROM trace""",
)
def read_alibaba(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "alibaba")
    _raw_alibaba(spark, folder).write.csv(path)
    return readers.standardize_alibaba(spark.read.schema(readers.ALIBABA).csv(path))


def _raw_tencent(spark: SparkSession, folder: str) -> DataFrame:
    """Every 100th record carries a flag that is neither read nor write."""
    return fixtures.trace(spark, folder).select(
        F.floor(F.col("ts_record") / 1000).cast("double").alias("timestamp"),
        (F.col("offset") / readers.SECTOR).cast("long").alias("offset"),
        (F.col("size") / readers.SECTOR).cast("long").alias("size"),
        F.when(F.col("event_id") % 100 == 99, 2).otherwise(1 - F.col("io_type")).alias("read"),
        F.col("disk_id").alias("volume"),
    )


@query(
    "src3_standardize_tencent",
    with_views(TRACE)
    + """ SELECT floor(ts_record / 1000) * 1000 AS ts_record, disk_id, "offset", size, io_type FROM trace
  WHERE event_id % 100 <> 99""",
)
def standardize_tencent(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tencent")
    _raw_tencent(spark, folder).write.csv(path)
    good, _ = readers.standardize_tencent(spark.read.schema(readers.TENCENT).csv(path))
    return good


@query(
    "src3_rejected_records",
    with_views(TRACE) + " SELECT disk_id AS volume, count(*) AS rejected FROM trace WHERE event_id % 100 = 99 GROUP BY 1",
)
def rejected_records(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = readers.standardize_tencent(_raw_tencent(spark, folder))
    return bad.groupBy("volume").agg(F.count(F.lit(1)).alias("rejected"))


def _raw_msrc(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.replayed(spark, folder).select(
        (F.floor(F.col("ts_record") * 10000) + 128_166_372_000_000_000).cast("long").alias("timestamp"),
        F.lit("host").alias("hostname"),
        F.col("disk_id").cast("string").alias("disk_id"),
        F.when(F.col("io_type") == 1, "Read").otherwise("Write").alias("type"),
        "offset",
        "size",
        F.col("latency").alias("response_time"),
    )


@query(
    "src4_standardize_msrc",
    with_views(TRACE)
    + """ SELECT round((t - min(t) OVER ()) * 1e-5, 6) AS ts_record, CAST(disk_id AS VARCHAR) AS disk_id, "offset", size, io_type
  FROM (SELECT *, CAST(floor(ts_record * 10000) AS BIGINT) AS t FROM trace)""",
)
def standardize_msrc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "msrc")
    _raw_msrc(spark, folder).write.option("compression", "gzip").csv(path)
    return rounded(readers.standardize_msrc(spark.read.schema(readers.MSRC).csv(path)))


def _raw_tectonic(spark: SparkSession, folder: str, year: int) -> DataFrame:
    rows = fixtures.trace(spark, folder).withColumns(
        {
            "block_id": F.col("event_id") % 1000,
            "io_offset": F.col("size"),
            "io_size": F.col("size"),
            "op_time": F.floor(F.col("ts_record") / 1000).cast("double"),
            "op_name": (F.col("event_id") % 6 + 1).cast("int"),
            "user_namespace": F.concat(F.lit("ns"), F.col("disk_id") % 3),
            "user_name": F.lit("u"),
            "host_name": F.concat(F.lit("h"), F.col("disk_id")),
            "op_count": F.lit(1).cast("long"),
            "pipeline": F.lit("p"),
            "rs_shard_id": F.lit("s"),
        }
    )
    names = spark.createDataFrame([], readers.TECTONIC[year]).columns
    return rows.where(F.col("event_id") % 3 == (0, 1, 2)[(2019, 2021, 2023).index(year)]).select(*names)


_TECTONIC_SQL = (
    with_views(TRACE)
    + """, t AS (SELECT *, floor(ts_record / 1000) AS s FROM trace)
  SELECT CAST(2019 + 2 * (event_id % 3) AS INTEGER) AS year, s - min(s) OVER (PARTITION BY event_id % 3) AS ts_record,
    CASE WHEN event_id % 3 = 0 THEN 'ns' || (disk_id % 3) ELSE 'h' || disk_id END AS disk_id,
    (event_id % 1000) * 8388608 + size AS "offset", size,
    CASE WHEN event_id % 6 + 1 IN (1, 2, 5) THEN 1 ELSE 0 END AS io_type FROM t"""
)


def _tectonic_files(spark: SparkSession, folder: str, year: int) -> str:
    """A third of the records as text in a year's layout, with ``#`` lines and a broken line for every 97th event."""
    raw = _raw_tectonic(spark, folder, year)
    lines = raw.select(F.concat_ws(" ", *raw.columns).alias("value"))
    heads = spark.createDataFrame([("# records",), ("# " + " ".join(raw.columns),)], "value string")
    third = F.col("event_id") % 3 == (year - 2019) // 2
    broken = fixtures.trace(spark, folder).where(third & (F.col("event_id") % 97 == 0)).select(F.concat_ws(" ", "event_id", "size", F.lit("x")).alias("value"))
    path = scratch_path(spark, f"tectonic-{year}")
    heads.union(lines).union(broken).write.text(path)
    return path


@query("src5_standardize_tectonic", _TECTONIC_SQL)
def standardize_tectonic(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the records in each year's layout, written and read back as text."""
    out = None
    for year in (2019, 2021, 2023):
        # Spark wrote several files, which stand for one here: the time starts anew in every file
        rows = readers.read_tectonic(spark, _tectonic_files(spark, folder, year), year).withColumn("file", F.lit(str(year)))
        part = readers.standardize_tectonic(rows).withColumn("year", F.lit(year)).drop("file")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "src5_rejected_records",
    with_views(TRACE) + " SELECT CAST(2019 + 2 * (event_id % 3) AS INTEGER) AS year, count(*) AS rejected FROM trace WHERE event_id % 97 = 0 GROUP BY 1",
)
def rejected_tectonic_records(spark: SparkSession, folder: str) -> DataFrame:
    parts = [readers.rejected_tectonic(spark, _tectonic_files(spark, folder, year), year).withColumn("year", F.lit(year)) for year in (2019, 2021, 2023)]
    return reduce(DataFrame.union, parts).groupBy("year").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "src6_read_msft",
    with_views(TRACE)
    + """ SELECT floor(ts_record / 1000) * 1000 AS ts_record, CAST(disk_id AS VARCHAR) AS disk_id, "offset", size, io_type FROM trace""",
)
def read_msft(spark: SparkSession, folder: str) -> DataFrame:
    raw = _raw_msrc(spark, folder).withColumn("timestamp", F.floor((F.col("timestamp") - 128_166_372_000_000_000) / 10_000_000))
    return readers.standardize_msft(raw)


_REPLAYED_SQL = with_views(TRACE, REPLAYED) + ' SELECT ts_record, latency, io_type, size, "offset", ts_submit, size_after_replay FROM replayed'


@query("src7_read_replayed", _REPLAYED_SQL)
def read_replayed(spark: SparkSession, folder: str) -> DataFrame:
    names = ["ts_record", "latency", "io_type", "size", "offset", "ts_submit", "size_after_replay"]
    path = scratch_path(spark, "replayed")
    fixtures.replayed(spark, folder).select(*names).write.csv(path)
    return readers.read_replayed(spark, path).select(*names)


@query(
    "src7_read_replayed_device",
    with_views(TRACE, REPLAYED) + ' SELECT ts_record, latency, io_type, size, "offset", ts_submit, CAST(disk_id AS INTEGER) AS device, ts_record AS ts FROM replayed',
)
def read_replayed_device(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "replayed-device")
    names = _write_replayed_device(fixtures.replayed(spark, folder), path)
    return readers.read_replayed(spark, path).select(*names)


def _write_replayed_device(rows: DataFrame, path: str) -> list[str]:
    rows = rows.withColumn("device", F.col("disk_id")).withColumn("ts", F.col("ts_record"))
    names = ["ts_record", "latency", "io_type", "size", "offset", "ts_submit", "device", "ts"]
    rows.select(*names).write.mode("append").csv(path)
    return names


@query(
    "src7_mixed_files",
    with_views(TRACE, REPLAYED)
    + """ SELECT ts_record, latency, io_type, size, "offset", ts_submit, CASE WHEN event_id % 2 = 0 THEN size_after_replay END AS size_after_replay,
    CASE WHEN event_id % 2 = 1 THEN CAST(disk_id AS INTEGER) END AS device, CASE WHEN event_id % 2 = 1 THEN ts_record END AS ts FROM replayed""",
)
def read_mixed_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of both forms in one folder."""
    path = scratch_path(spark, "replayed-mixed")
    rows = fixtures.replayed(spark, folder)
    _write_replayed_device(rows.where("event_id % 2 = 1"), path)
    names = ["ts_record", "latency", "io_type", "size", "offset", "ts_submit", "size_after_replay"]
    rows.where("event_id % 2 = 0").select(*names).write.mode("append").csv(path)
    return readers.read_replayed(spark, path)


@query("src8_volume_scan", with_views(TRACE) + " SELECT disk_id AS volume, count(*) AS n FROM trace GROUP BY 1")
def volume_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tencent")
    _raw_tencent(spark, folder).write.csv(path)
    return readers.volumes(spark, path).groupBy("volume").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src9_dataset_discovery",
    with_views(TRACE, REPLAYED) + " SELECT chunk, count(*) AS n, sum(size)::BIGINT AS bytes FROM replayed WHERE chunk <> 3 GROUP BY 1",
)
def dataset_discovery(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    rows = fixtures.replayed(spark, folder)
    rows.select("chunk", "ts_record", "latency", "size").write.partitionBy("chunk").csv(path)
    keep = ~F.col(readers.PATH).rlike("chunk=3/")
    found = readers.discover_chunks(spark, f"{path}/*/*.csv", "ts_record double, latency bigint, size bigint", keep=keep)
    return found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    "src10_window_list",
    with_views(TRACE)
    + """, w AS (SELECT DISTINCT disk_id, CAST(floor(ts_record / 86400000) AS BIGINT) AS day FROM trace)
  SELECT 'g' || disk_id AS "group", row_number() OVER (PARTITION BY disk_id ORDER BY day) - 1 AS ord,
    CASE WHEN day % 2 = 0 THEN 'k' || day
      ELSE CAST(count(*) FILTER (WHERE day % 2 = 1) OVER (PARTITION BY disk_id ORDER BY day) - 1 AS VARCHAR) END AS key,
    'w' || day AS name FROM w""",
)
def window_list(spark: SparkSession, folder: str) -> DataFrame:
    """One list file per device, with named and bare entries, comments and blank lines."""
    day = F.floor(F.col("ts_record") / fixtures.DAY_MS)
    days = fixtures.trace(spark, folder).select("disk_id", day.alias("day")).distinct()
    name = F.concat(F.lit("w"), F.col("day"))
    entry = F.when(F.col("day") % 2 == 0, F.concat(F.lit("k"), F.col("day"), F.lit(": "), name, F.lit("  # kept"))).otherwise(name)
    listed = days.groupBy("disk_id").agg(F.array_sort(F.collect_list(F.struct("day", entry.alias("entry")))).alias("_e"))
    lines = F.concat(
        F.array(F.lit("# windows"), F.lit(""), F.concat(F.lit("! g"), F.col("disk_id"))), F.transform("_e", lambda e: e["entry"])
    )
    path = scratch_path(spark, "lists")
    listed.select("disk_id", F.array_join(lines, "\n").alias("text")).write.partitionBy("disk_id").text(path)
    return readers.read_window_lists(spark, f"{path}/*/*.txt").drop("file")


@query(
    "src11_read_results",
    with_views(TRACE, PREDICTION)
    + """ SELECT CASE model WHEN 'm0' THEN 'initial-only' WHEN 'm1' THEN 'retrain-entropy' ELSE 'renew' END AS algo, window_id,
    round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM prediction GROUP BY ALL""",
)
def read_results(spark: SparkSession, folder: str) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    scores = fixtures.prediction(spark, folder).groupBy("model", "window_id").agg(F.round(F.avg(hit), 6).alias("accuracy"))
    name = F.element_at(F.create_map(*[F.lit(v) for v in ("m0", "initial", "m1", "retrain_entropy", "m2", "renew_recent")]), F.col("model"))
    path = scratch_path(spark, "results")
    scores.withColumn("run", name).drop("model").write.partitionBy("run").option("header", True).csv(path)
    return readers.read_results(spark, f"{path}/*/*.csv", "window_id bigint, accuracy double")


@query(
    "src12_drift_of_path",
    with_views(TRACE)
    + """ SELECT type, (event_id % 50) || '_' || (event_id % 50 + 10) AS start_end, count(*) AS n
  FROM (SELECT event_id, CASE disk_id % 4 WHEN 0 THEN 'sudden' WHEN 1 THEN 'gradual' WHEN 2 THEN 'incremental' ELSE 'recurring' END AS type
    FROM trace) GROUP BY ALL""",
)
def drift_of_path(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in ("sudden", "gradual", "incremental", "recurring")]), (F.col("disk_id") % 4 + 1).cast("int"))
    start = F.col("event_id") % 50
    path = F.concat_ws("/", F.lit("/data"), kind, F.concat(start, F.lit("_"), start + 10), F.lit("done"))
    found, span = readers.drift_of_path(path)
    return fixtures.trace(spark, folder).groupBy(found.alias("type"), span.alias("start_end")).agg(F.count(F.lit(1)).alias("n"))
