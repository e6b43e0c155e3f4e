"""Named queries over the given tables, each next to the SQL it must agree with."""

from spindle.plans import (  # noqa: F401
    aggregates,
    distributions,
    drifts,
    evaluation,
    joins,
    labels,
    learning,
    projections,
    samples,
    sequences,
    sinks,
    sources,
    streams,
    windows,
)
from spindle.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
