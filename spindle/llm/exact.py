"""Exact duplicates, merged in steps that no single hot text can overload.

1. Local: each partition groups its own rows by digest and text.
2. Salted: the local winners meet by digest, text and a salt taken from the partition they come from, so that a text that
   a third of all rows share is spread over ``salts`` tasks.
3. Global: one winner for each salt is left, and these meet by digest and text.

The text itself is part of the key in every step: equal digests of different texts never merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text_column: str = "text") -> Column:
    """Each run of white space (ASCII) becomes one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text_column), r"[\x20\x09-\x0D]+", " ")


def _winners(bodies: DataFrame, salts: int) -> DataFrame:
    """(digest, body, keep_id, n) for each distinct text of (doc_id, digest, body)."""
    salted = bodies.groupBy("digest", "body", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    merged = salted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text).

    The least id of a group of equal texts stays. Null ids count in the size but win only where a group has no other,
    and are kept then; rows that repeat the winning id are all marked as kept. An empty table gives an empty result.
    """
    body = normalised(text_column)
    named = F.col(id_column).alias("doc_id")
    members = staged(docs.select(named, digest(body).alias("digest"), sha256(body).alias("text_sha256")))
    bodies = docs.select(named, body.alias("body")).withColumn("digest", digest(F.col("body")))
    winners = staged(_winners(bodies, salts).select("digest", "keep_id", "n"))
    shared = staged(winners.groupBy("digest").count().where(F.col("count") > 1).select("digest"))
    out = members.join(winners, "digest")
    if not shared.isEmpty():  # digests of several texts: there the text itself finds the group
        out = out.join(shared, "digest", "left_anti")
        clashing = bodies.join(shared, "digest", "left_semi")
        clashing = clashing.join(_winners(clashing, salts), ["digest", "body"])
        columns = ["digest", "doc_id", "text_sha256", "keep_id", "n"]
        out = out.select(*columns).union(clashing.withColumn("text_sha256", sha256(F.col("body"))).select(*columns))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
