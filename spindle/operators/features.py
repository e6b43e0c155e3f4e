"""Model inputs from labelled traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.label import rounded_throughput
from spindle.operators.ordered import Groups, ordered
from spindle.operators.sequence import queue_length, with_previous

# fixed values: the model inputs, in order
FEATURES = (
    "size", "queue_len", "prev_queue_len_1", "prev_queue_len_2", "prev_queue_len_3", "prev_latency_1", "prev_latency_2",
    "prev_latency_3", "prev_throughput_1", "prev_throughput_2", "prev_throughput_3",
)
N_HISTORY = 3


def feature_set(
    df: DataFrame, device: Sequence[str], chunk: str, order: Sequence[str], rolling: bool = True, trace: DataFrame | None = None
) -> DataFrame:
    """Queue length and the last three queue lengths, latencies and throughputs of every request.

    ``rolling`` looks back across chunk borders of a device, so only its first three rows lack history and are
    dropped. Otherwise every chunk is compared with the end of the device's first chunk. Writes are never rejected.
    ``trace`` is the unlabelled trace, if at hand: group sizes are taken from it, which is cheaper than from ``df``.
    """
    trace = df if trace is None else trace
    rows = queue_length(rounded_throughput(df), [*device, chunk], order[-1], sizes=trace)
    columns = ["queue_len", "latency", "throughput"]
    made = [f"prev_{c}_{i}" for c in columns for i in range(1, N_HISTORY + 1)]
    if rolling:
        seq = with_previous(ordered(rows, device, [chunk, *order], Groups.measure(trace, device)), columns, N_HISTORY).frame()
    else:
        first = rows.groupBy(*device).agg(F.min(chunk).alias("_first_chunk"))
        marked = rows.join(first, list(device))
        back = [F.col(o).cast("double") * -1 for o in order]
        opening = marked.where(F.col(chunk) == F.col("_first_chunk")).withColumns({f"_b{i}": b for i, b in enumerate(back)})
        tails = ordered(opening, device, [f"_b{i}" for i in range(len(back))], Groups.measure(trace, device)).numbered("_n").frame()
        tails = tails.where(F.col("_n") <= N_HISTORY).drop("_n", *[f"_b{i}" for i in range(len(back))])
        later = marked.where(F.col(chunk) != F.col("_first_chunk"))
        # the three rows go in front of every later chunk; a device has few chunks compared with rows
        heads = tails.drop(chunk).join(later.select(*device, chunk).distinct(), list(device)).select(*later.columns)
        both = later.withColumn("_own", F.lit(1)).unionByName(heads.withColumn("_own", F.lit(0)))
        both = both.unionByName(marked.where(F.col(chunk) == F.col("_first_chunk")).withColumn("_own", F.lit(1)))
        sizes = Groups.measure(trace, [*device, chunk])
        seq = with_previous(ordered(both, [*device, chunk], ["_own", *order], sizes), columns, N_HISTORY).frame()
        seq = seq.where(F.col("_own") == 1).drop("_own", "_first_chunk")
    complete = seq.where(F.col(made[N_HISTORY - 1]).isNotNull())
    complete = complete.withColumn("reject", F.when(F.col("io_type") == 0, 0).otherwise(F.col("reject")))
    return complete.drop("throughput", "throughput_drop")


def change_ratios(df: DataFrame) -> DataFrame:
    """Latency increase and throughput drop against the previous request."""
    rows = rounded_throughput(df) if "throughput" not in df.columns else df
    return rows.withColumns(
        {
            "latency_increase": F.rint(F.try_divide(F.col("latency").cast("double"), F.col("prev_latency_1").cast("double")) * 100) / 100,
            "throughput_drop": F.rint(F.col("prev_throughput_1") / (F.col("throughput") + 0.1) * 100) / 100,
        }
    )


def readonly(df: DataFrame) -> DataFrame:
    """Reads only, without the now constant type."""
    return df.where(F.col("io_type") == 1).drop("io_type")


def model_columns(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: int | None = None) -> DataFrame:
    """Keys, the model inputs and ``reject`` of the reads; optionally only the newest ``last`` rows of the trace."""
    reads = df.where(F.col("io_type") == 1)
    if last is not None:
        # distributed top-k: each task keeps its own newest rows first
        reads = reads.orderBy(*[F.col(o).desc() for o in order]).limit(last)
    return reads.select(*keys, *FEATURES, "reject")
