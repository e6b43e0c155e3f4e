"""Windows that start anew after a gap.

Records are picked up step by step: a pick holds the records from just behind the last one up to the width of a window;
if there are none, the next pick starts at the next record. A pick joins the records that are open, of which those
further than the width before the last one are dropped. If what is open then spans the width, up to a tolerance, it
becomes a window and nothing is open any more.

Both steps are chains through a forest. The last record of a pick follows from the last record of the pick before it alone,
so every record has a successor, found as of the end of its pick. Which pick closes a window follows from the pick after
the window before: the first pick or the second one still reach back to the first record of the window, every later one
is longer than the width and stands for itself. What is reached from the first record is found by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.ordered import asof, ordered
from spindle.session import stable


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, node) of all nodes on the paths from ``roots`` (g, node) along ``edges`` (g, node, to).

    Every node has one edge at most and paths have no circles. Each round doubles the length of the jumps, so there are as
    many rounds as the longest path has binary digits.
    """
    found = stable(roots.select("g", "node"))
    jumps = stable(edges.where("to is not null").select("g", "node", "to"))
    while not jumps.isEmpty():
        ahead = found.join(jumps, ["g", "node"]).select("g", F.col("to").alias("node"))
        found = stable(found.union(ahead))
        second = jumps.select("g", F.col("node").alias("to"), F.col("to").alias("further"))
        jumps = stable(jumps.join(second, ["g", "to"]).select("g", "node", F.col("further").alias("to")))
    return found


def _picks(times: DataFrame, width: int) -> DataFrame:
    """(g, k, f, l): first and last time of every pick, numbered from 1 per group."""
    starts = times.groupBy("g").agg((F.min("t") - 1).alias("t"))  # a node before the first record
    nodes = ordered(times.unionByName(starts), ["g"], ["t"]).shifted({"f": lambda w: F.lead("t").over(w)}, after=1).frame()
    # the first record of a pick may lie behind the start of the pick, whose end counts from the start
    nodes = nodes.where("f is not null").withColumn("end", F.when(F.col("f") <= F.col("t") + width, F.col("t") + width).otherwise(F.col("f") + width - 1))
    last = times.select("g", F.col("t").alias("end"), F.col("t").alias("l"))
    edges = stable(asof(nodes, last, ["g"], "end", "l").select("g", F.col("t").alias("node"), "f", "l"))
    on_path = reached(edges.select("g", "node", F.col("l").alias("to")), starts.select("g", F.col("t").alias("node")))
    return stable(ordered(edges.join(on_path, ["g", "node"]).select("g", "f", "l"), ["g"], ["l"]).numbered("k").frame())


def restarted_spans(df: DataFrame, keys: Sequence[str], width_ms: int, ts: str = "ts_record", tolerance_s: float = 0.5) -> DataFrame:
    """(keys, window_id, start_t, end_t): the windows of each group, counted from 0, times in tenths of a millisecond.

    Times are taken to a tenth of a millisecond. Records without a time are in no window; null keys are a group; what is
    open at the end is no window. An empty table gives an empty result.
    """
    width, tolerance = int(width_ms) * 10, round(tolerance_s * 10_000)
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("g")
    times = stable(df.where(F.col(ts).isNotNull()).select(group, F.round(F.col(ts) * 10).cast("long").alias("t")).distinct())
    picks = _picks(times, width).withColumn("back", F.col("l") - width)
    within = times.select("g", F.col("t").alias("back"), F.col("t").alias("b"))
    picks = stable(asof(picks, within, ["g"], "back", "b", ahead=True).drop("back"))  # b: first time within the width

    def full(start):
        return lambda last: F.abs(last - start - width) <= tolerance

    rows = ordered(picks, ["g"], ["k"])
    rows = rows.running({"own": ("min", F.when(full(F.col("b"))(F.col("l")), F.col("k")))}, backward=True)
    ahead = {"l2": ("l", 1), "b2": ("b", 1), "later": ("own", 2)}
    rows = rows.shifted({n: (lambda w, c=c, by=by: F.lead(c, by).over(w)) for n, (c, by) in ahead.items()}, after=2).frame()
    second = F.greatest("f", "b2")
    closes = F.when(full(F.col("f"))(F.col("l")), F.col("k")).when(full(second)(F.col("l2")), F.col("k") + 1).otherwise(F.col("later"))
    closed = stable(rows.select("g", "k", "f", closes.alias("closes")).where("closes is not null"))
    path = reached(
        closed.select("g", F.col("k").alias("node"), (F.col("closes") + 1).alias("to")),
        picks.where("k = 1").select("g", F.col("k").alias("node")),
    )
    ends = picks.select("g", F.col("k").alias("closes"), "l", "b")
    found = closed.join(path.withColumnRenamed("node", "k"), ["g", "k"]).join(ends, ["g", "closes"])
    spans = found.select("g", F.greatest("f", "b").alias("start_t"), F.col("l").alias("end_t"))
    spans = ordered(spans, ["g"], ["start_t"]).numbered("n").frame()
    return spans.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], (F.col("n") - 1).alias("window_id"), "start_t", "end_t")


def restarted_windows(df: DataFrame, keys: Sequence[str], width_ms: int, ts: str = "ts_record", tolerance_s: float = 0.5) -> DataFrame:
    """The records within windows of ``restarted_spans``, with ``window_id``."""
    spans = stable(restarted_spans(df, keys, width_ms, ts, tolerance_s))
    facts = spans.select(*keys, F.col("start_t").alias("__t"), F.struct("window_id", "end_t").alias("__window"))
    rows = df.where(F.col(ts).isNotNull()).withColumn("__t", F.round(F.col(ts) * 10).cast("long"))
    placed = asof(rows, facts, keys, "__t", "__window").where(F.col("__t") <= F.col("__window.end_t"))
    return placed.withColumn("window_id", F.col("__window.window_id")).drop("__t", "__window")
