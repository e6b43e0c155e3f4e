"""Online forms of the window operators, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindle.functions.scalars import ratio

PERCENTILES = (0.5, 0.9, 0.99)


def with_event_time(df: DataFrame, ts: str = "ts_record", delay: str = "10 minutes") -> DataFrame:
    """A timestamp from the numeric clock (ms), with a watermark."""
    seconds = F.timestamp_micros((F.col(ts) * 1000).cast("long"))
    return df.withColumn("event_time", seconds).withWatermark("event_time", delay)


def window_characteristics(stream: DataFrame, width: str, slide: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """Counts, rates and sketch-based percentiles per device and window; state is one small row per open window."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    seconds = (F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))) / 1_000_000
    stats = stream.groupBy(window, "disk_id").agg(
        F.count(F.lit(1)).alias("num_io"),
        F.count_if(F.col("io_type") == 1).alias("read_count"),
        F.sum("size").alias("size_sum"),
        F.avg("latency").alias("latency_avg"),
        F.percentile_approx("latency", list(PERCENTILES), accuracy).alias("latency_percentiles"),
    )
    return stats.select(
        F.col("window.start").alias("window_start"),
        "disk_id",
        "num_io",
        "read_count",
        (F.col("num_io") - F.col("read_count")).alias("write_count"),
        "size_sum",
        "latency_avg",
        "latency_percentiles",
        ratio(F.col("num_io"), seconds).alias("iops"),
    )


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Stretches of activity per device, closed by a pause."""
    closed = stream.groupBy(F.session_window("event_time", gap), "disk_id").agg(
        F.count(F.lit(1)).alias("num_io"), F.sum("size").alias("size_sum")
    )
    return closed.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "disk_id", "num_io", "size_sum")


def online_concept_ends(stream: DataFrame, threshold: float, offset: float, window: int = 10, stability: int = 14) -> DataFrame:
    """Ends of stable concepts of each series as its rows arrive, in order per series.

    The calm test needs the rows ahead, so a row is judged once ``window - 1`` later rows have come. State is the last
    ``2 * window`` groups of a series and three counters.
    """
    half = window // 2

    def group_of(value: float) -> int:
        if value < 0:
            return 0
        return 1 if value - 1 <= offset else int((value - offset) / threshold) + 2

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        groups, idx, steady, prev_own = state.get if state.exists else ([], -1, -1, 0)
        groups = list(groups)
        ends = []
        for value in pd.concat(list(parts)).sort_values("idx")["value"]:
            groups.append(group_of(value))
            # judged rows first, at most ``window`` of them, then the rows that still wait
            at = min(idx + 1, window)
            if len(groups) - at < window:
                continue
            own_group, trailing = groups[at], groups[max(0, at - window) : at + 1]
            own = trailing.count(own_group)
            near = sum(1 for g in trailing if g != own_group and abs(g - own_group) <= 2)
            ahead = groups[at : at + window].count(own_group)
            calm = len(trailing) < window or (own > half and ahead > half) or prev_own > half or near > half
            idx += 1
            if idx > 0 and not calm and steady >= stability:
                ends.append((idx - 1, steady))
            steady = steady + 1 if calm and idx > 0 else 0
            prev_own = own
            if at == window:
                groups = groups[1:]
        state.update((groups, idx, steady, prev_own))
        yield pd.DataFrame({"series": [key[0]] * len(ends), "end_idx": [e[0] for e in ends], "stability": [e[1] for e in ends]})

    return stream.groupBy("series").applyInPandasWithState(
        advance,
        outputStructType="series string, end_idx bigint, stability bigint",
        stateStructType="groups array<int>, idx bigint, steady bigint, prev_own int",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def split_late(stream: DataFrame, width_ms: int, delay_ms: int, on_time: str, late: str, marks: str, checkpoint: str) -> StreamingQuery:
    """Append rows to one table, and rows more than ``delay_ms`` behind the newest earlier batch to another.

    The newest time of every batch is kept in ``marks``, so a restarted or repeated batch sees the same border and
    replaces its own output.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        border = None
        if batch_id > 0:
            before = spark.read.schema("high double, batch_id bigint").parquet(marks).where(F.col("batch_id") < batch_id)
            border = before.agg(F.max("high")).first()[0]
        is_late = F.lit(False) if border is None else F.col("ts_record") < border - delay_ms
        tagged = batch.withColumn("window_id", F.floor(F.col("ts_record") / width_ms))
        for path, rows in ((on_time, tagged.where(~is_late)), (late, tagged.where(is_late))):
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        high = batch.agg(F.max("ts_record").alias("high"))  # one row
        high.write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return start_batches(stream, route, checkpoint)


def score_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch: evaluation, confidence cells, and whether to retrain or renew, one row per model."""
    from spindle.operators import evaluate as ev

    def judge(batch: DataFrame, batch_id: int) -> None:
        scores = ev.evaluate(batch, ["model"])
        cases = ev.confidence_cases(batch, ["model"]).drop("num_io")
        chosen = batch.where(ev.entropy(F.col("probability")) > 0.85).groupBy("model").agg(F.count(F.lit(1)).alias("retrain_rows"))
        rows = ev.needs_renewal(scores).join(cases, "model").join(chosen, "model", "left").fillna(0, subset=["retrain_rows"])
        rows.withColumn("retrain", F.col("retrain_rows") >= 100).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_batches(stream, judge, checkpoint)


def start_batches(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
