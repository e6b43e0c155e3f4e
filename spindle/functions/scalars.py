"""Scalar helpers: durations, percent texts, safe ratios, throughput, value groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: minutes per unit, in the spellings the duration texts use
MINUTES_PER_UNIT = {"m": 1, "min": 1, "h": 60, "hr": 60, "hour": 60, "hours": 60, "d": 1440, "day": 1440, "days": 1440}


def duration_minutes(text: str | int) -> int:
    """``90``, ``10m``, ``10min``, ``2hours``, ``1d`` as minutes."""
    found = re.fullmatch(r"(\d+)([a-z]*)", str(text))
    if not found or (found[2] and found[2] not in MINUTES_PER_UNIT):
        raise ValueError(f"not a duration: {text}")
    return int(found[1]) * MINUTES_PER_UNIT.get(found[2], 1)


def duration_ms(text: str | int) -> int:
    return duration_minutes(text) * 60_000


def duration_minutes_column(text: Column) -> Column:
    """The same as a column; null for texts that are no duration."""
    units = F.create_map(*[F.lit(x) for unit, n in {"": 1, **MINUTES_PER_UNIT}.items() for x in (unit, n)])
    number = F.regexp_extract(text, r"^(\d+)[a-z]*$", 1)
    unit = F.regexp_extract(text, r"^\d+([a-z]*)$", 1)
    return F.when(number != "", number.cast("long") * F.try_element_at(units, unit))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def throughput(size: Column, latency: Column) -> Column:
    """Bytes per us; infinite for a zero latency, as float division gives."""
    infinite = F.when(size == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(latency == 0, infinite).otherwise(F.try_divide(size.cast("double"), latency.cast("double")))


def finite(value: Column) -> Column:
    """Null instead of an infinite value."""
    value = value.cast("double")
    return F.when(~value.isin(float("inf"), float("-inf")), value)


def round_half_even(value: Column, digits: int = 0) -> Column:
    """numpy's ``round``: scale, round half to even, scale back."""
    return F.rint(value * float(10**digits)) / float(10**digits) if digits else F.rint(value)


def percent_text(part: Column, whole: Column, digits: int = 2) -> Column:
    """``12.34%``; ``0%`` when there is nothing to divide by."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.when(whole == 0, F.lit("0%")).otherwise(F.concat(F.round(share, digits).cast("string"), F.lit("%")))


def value_group(value: Column, threshold: float, offset: float) -> Column:
    """Step a value falls into: 0 below zero, 1 up to ``offset + 1``, then one more per ``threshold``."""
    steps = ((value - offset) / threshold).cast("int") + 2
    return F.when(value < 0, 0).when(value - 1 <= offset, 1).otherwise(steps).cast("int")
