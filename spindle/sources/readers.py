"""Readers: raw trace formats to DataFrames, always with an explicit schema."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators.ordered import Groups, ordered

# fixed values: column layouts of the formats
CANONICAL = "ts_record double, disk_id bigint, offset bigint, size bigint, io_type int"
TENCENT = "timestamp double, offset bigint, size bigint, read int, volume bigint"
ALIBABA = "device_id int, opcode string, offset bigint, length int, timestamp bigint"
MSRC = "timestamp bigint, hostname string, disk_id string, type string, offset bigint, size bigint, response_time bigint"
REPLAYED = "ts_record double, latency bigint, io_type int, size bigint, offset bigint, ts_submit double, size_after_replay bigint"
REPLAYED_DEVICE = "ts_record double, latency bigint, io_type int, size bigint, offset bigint, ts_submit double, device int, ts double"
_TECTONIC = "block_id bigint, io_offset bigint, io_size bigint, op_time double, op_name int"
TECTONIC = {
    2019: f"{_TECTONIC}, pipeline string, user_namespace string, user_name string",
    2021: f"{_TECTONIC}, user_namespace string, user_name string, host_name string, op_count bigint",
    2023: f"{_TECTONIC}, user_namespace string, user_name string, rs_shard_id string, op_count bigint, host_name string",
}
# fixed values: block size, read operations, sector size
TECTONIC_BLOCK = 8 * 1024 * 1024
TECTONIC_READS = (1, 2, 5)
SECTOR = 512
PATH = "_path"
ARCHIVES = (".tar", ".tar.gz", ".tgz")
#: Stores whose files a task can open by itself.
STREAMED = ("file", "s3", "gs")
DRIFT_TYPES = "sudden|gradual|incremental|recurring|0\\.5|1\\.5"


def read_trace(spark: SparkSession, path: str | Sequence[str], schema: str = CANONICAL, sep: str = " ") -> DataFrame:
    """Delimited text, plain or gzipped, and ``.tar``, ``.tar.gz`` and ``.tgz`` archives of it (``read_archives``), also mixed."""
    paths = [path] if isinstance(path, str) else list(path)
    archives = [p for p in paths if p.endswith(ARCHIVES)]
    plain = [p for p in paths if not p.endswith(ARCHIVES)]
    parts = [spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(plain)] if plain else []
    if archives:
        parts.append(read_archives(spark, archives, schema, sep))
    return reduce(DataFrame.unionByName, parts)


def _scheme(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"\w+:", path) else "file"


def _stream(path: str):
    """The bytes of a file one after the other."""
    found, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return found.open_input_stream(inside, compression=None)


class _Forward(io.RawIOBase):
    """A member of a streamed archive, which can only be read on."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _members(file, schema: list[str], sep: str, rows: int) -> Iterator[pd.DataFrame]:
    """Rows of the files in an archive, in batches; the archive is read once, from start to end."""
    with tarfile.open(fileobj=file, mode="r|*") as archive:
        for member in archive:
            if member.isfile() and member.size:
                yield from pd.read_csv(io.BufferedReader(_Forward(archive.extractfile(member)), 1 << 20), sep=sep, names=schema, chunksize=rows)


def read_archives(spark: SparkSession, paths: Sequence[str], schema: str, sep: str = " ", rows: int = 100_000) -> DataFrame:
    """Rows of the files inside tar archives, a task per archive, which streams it in batches whatever its size.

    Archives in a store that only Spark can open come as one value each, and are limited to 2 GB.
    """
    names = spark.createDataFrame([], schema).columns
    found = spark.read.format("binaryFile").load(list(paths))
    streamed = all(_scheme(p) in STREAMED for p in paths)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if streamed:
                for path in part["path"]:
                    with _stream(path) as file:
                        yield from _members(file, names, sep, rows)
            else:
                for content in part["content"]:
                    yield from _members(io.BytesIO(content), names, sep, rows)

    if not streamed:
        return found.select("content").mapInPandas(unpack, schema)
    listed = found.select("path")  # names only: the contents are not read here
    return listed.repartition(max(1, listed.count()), "path").mapInPandas(unpack, schema)


def with_path(df: DataFrame) -> DataFrame:
    return df.withColumn(PATH, F.input_file_name())


def chunk_of(path: Column) -> Column:
    """Number in ``chunk_<n>`` or ``chunk=<n>``, null if there is none."""
    number = F.regexp_extract(path, r"chunk[_=](\d+)", 1)
    return F.when(number != "", number.cast("long"))


def discover_chunks(spark: SparkSession, pattern: str, schema: str, sep: str = ",", keep: Column | None = None) -> DataFrame:
    """Rows of all files a glob matches, each with its ``chunk`` number; files whose path ``keep`` refuses are not read."""
    read = spark.read.schema(schema).option("sep", sep).csv(pattern)
    rows = read.select("*", F.col("_metadata.file_path").alias(PATH))
    if keep is not None:
        rows = rows.where(keep)
    return rows.withColumn("chunk", chunk_of(F.col(PATH))).drop(PATH)


def standardize_tencent(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seconds to ms, sectors to bytes, 0 = read to 1 = read. Second result: the rows that are not valid."""
    fields = ["timestamp", "offset", "size", "read", "volume"]
    valid = F.col("read").isin(0, 1)
    for name in fields:
        valid = valid & F.col(name).isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    good = raw.where(valid).select(
        (F.col("timestamp") * 1000).cast("double").alias("ts_record"),
        F.col("volume").alias("disk_id"),
        (F.col("offset") * SECTOR).alias("offset"),
        (F.col("size") * SECTOR).alias("size"),
        (1 - F.col("read")).alias("io_type"),
    )
    return good, raw.where(~valid)


def standardize_alibaba(raw: DataFrame) -> DataFrame:
    return raw.select(
        (F.col("timestamp") / 1000).alias("ts_record"),
        F.col("device_id").cast("long").alias("disk_id"),
        "offset",
        F.col("length").cast("long").alias("size"),
        (F.col("opcode") == "R").cast("int").alias("io_type"),
    )


def standardize_msrc(raw: DataFrame) -> DataFrame:
    """Ticks since the first record, times 1e-5; ``Read`` is 1."""
    start = F.broadcast(raw.agg(F.min("timestamp").alias("_t0")))  # one row
    return raw.join(start).select(
        ((F.col("timestamp") - F.col("_t0")) * 0.00001).alias("ts_record"),
        "disk_id",
        "offset",
        "size",
        (F.col("type") == "Read").cast("int").alias("io_type"),
    )


def standardize_msft(raw: DataFrame) -> DataFrame:
    """Seconds to ms; ``Read`` is 1."""
    return raw.select((F.col("timestamp") * 1000.0).alias("ts_record"), "disk_id", "offset", "size", (F.col("type") == "Read").cast("int").alias("io_type"))


def standardize_tectonic(raw: DataFrame, file: str = "file") -> DataFrame:
    """Time since the file's first record; offset in the block's 8 MiB; the host as device, or the namespace where there is none."""
    starts = raw.groupBy(file).agg(F.min("op_time").alias("_t0"))
    disk = "host_name" if "host_name" in raw.columns else "user_namespace"
    return Groups.measure(raw, [file]).join(raw, starts).select(
        file,
        (F.col("op_time") - F.col("_t0")).alias("ts_record"),
        F.col(disk).alias("disk_id"),
        (F.col("block_id") * TECTONIC_BLOCK + F.col("io_offset")).alias("offset"),
        F.col("io_size").alias("size"),
        F.col("op_name").isin(*TECTONIC_READS).cast("int").alias("io_type"),
    )


def _tectonic_lines(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Lines with text that are no ``#`` line: ``value``, ``file`` and the parsed record ``_r``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    options = {"sep": " ", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.withColumn("_r", F.from_csv("value", f"{TECTONIC[year]}, _corrupt string", options))


def read_tectonic(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Space-separated records of one year's layout, with the ``file`` they came from; ``#`` lines are skipped.

    Lines that are no record of the layout are in ``rejected_tectonic``, whatever columns are used here.
    """
    rows = _tectonic_lines(spark, path, year).where("_r._corrupt is null")
    return rows.select("_r.*", "file").drop("_corrupt")


def rejected_tectonic(spark: SparkSession, path: str, year: int) -> DataFrame:
    """(file, value): the lines that ``read_tectonic`` leaves out, but for ``#`` and empty lines."""
    return _tectonic_lines(spark, path, year).where("_r._corrupt is not null").select("file", "value")


def read_replayed(spark: SparkSession, path: str) -> DataFrame:
    """The 7-column form and the 8-column form with a device, told apart line by line; what a form lacks is null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wide = F.size(F.split("value", ",")) == 8
    forms = [F.when(chosen, F.from_csv("value", layout)).alias(name) for name, chosen, layout in (("_w", wide, REPLAYED_DEVICE), ("_n", ~wide, REPLAYED))]
    both = [f"coalesce(_w.{c}, _n.{c}) AS {c}" for c in ("ts_record", "latency", "io_type", "size", "offset", "ts_submit")]
    return lines.select(*forms).selectExpr(*both, "_n.size_after_replay", "_w.device", "_w.ts")


def read_window_lists(spark: SparkSession, path: str) -> DataFrame:
    """Window lists: ``! group`` lines, then ``key: name`` lines or bare names keyed by position; ``#`` starts a comment."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "_raw"))
    text = F.trim(F.regexp_extract(F.col("_raw"), r"^([^#]*)", 1))
    lines = lines.withColumn("_text", text).where(F.col("_text") != "")
    header = F.when(F.col("_text").startswith("!"), F.trim(F.expr("substring(_text, 2)")))
    rows = ordered(lines.withColumn("_head", header), ["file"], ["line"]).running({"group": ("last", F.col("_head"))}).frame()
    entries = rows.where(F.col("_head").isNull() & F.col("group").isNotNull())
    named = F.col("_text").contains(":")
    entries = ordered(entries.withColumn("_bare", (~named).cast("long")), ["file", "group"], ["line"])
    entries = entries.numbered("ord").running({"_count": ("sum", F.col("_bare"))}).frame()
    parts = F.split("_text", ":")
    return entries.select(
        F.col("group"),
        (F.col("ord") - 1).alias("ord"),
        F.when(named, F.trim(parts[0])).otherwise((F.col("_count") - 1).cast("string")).alias("key"),
        F.when(named, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(F.col("_text")).alias("name"),
    )


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All ``results`` files a glob matches, with the policy (``algo``) named by their folder."""
    rows = with_path(spark.read.schema(schema).option("header", True).csv(pattern))
    folder = F.regexp_extract(F.col(PATH), r"([^/=]+)/[^/]+$", 1)
    return rows.withColumn("algo", algorithm_name(folder)).drop(PATH)


def algorithm_name(folder: Column) -> Column:
    """Display name of a policy from its folder."""
    return (
        F.when(folder.contains("initial"), "initial-only")
        .when(folder.contains("retrain"), F.concat(F.lit("retrain-"), F.regexp_extract(folder, r"retrain_?(\w*)", 1)))
        .when(folder.contains("renew"), "renew")
        .otherwise(F.regexp_replace(folder, "_", "-"))
    )


def drift_of_path(path: Column) -> tuple[Column, Column]:
    """Drift type and ``start_end`` from a path."""
    return F.regexp_extract(path, f"/({DRIFT_TYPES})", 1), F.regexp_extract(path, r"(\d+_\d+)", 1)


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """Only the device column of raw records."""
    return spark.read.schema(TENCENT).csv(path).select("volume")
