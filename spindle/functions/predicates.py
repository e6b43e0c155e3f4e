"""Filters given as text, and the helpers such texts use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a SQL predicate over the columns holds."""
    return df.where(F.expr(predicate))


def minutes(ts_ms: Column) -> Column:
    return ts_ms / F.lit(60_000.0)


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether one of ``parts`` occurs in the text."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def within_any(text: Column, wholes: Sequence[str]) -> Column:
    """Whether the text occurs in one of ``wholes``."""
    return F.exists(F.array(*[F.lit(w) for w in wholes]), lambda w: F.contains(w, text))


def contiguous_chunks(chunk: Column, first: int, last: int) -> Column:
    return chunk.between(first, last)
