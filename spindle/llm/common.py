"""What the text operators share: staged tables, word and row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import scratch_path

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows handed to a Python worker at once: some MB of whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Write to the shared folder and read back; Python workers get small batches of ``rows`` meanwhile."""
    path = scratch_path(df.sparkSession, "stage")
    write_batched(df, path, rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_batched(df: DataFrame, path: str, rows: int = BATCH_ROWS) -> None:
    """Write as Parquet; Python workers get whole texts, or other large rows, in batches of so many meanwhile."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, str(rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_CONF, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_digest(df: DataFrame) -> Column:
    """A hash of all columns of a row: orders rows that share an id."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
