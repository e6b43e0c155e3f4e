"""Streaming forms against the batch operators."""

from pyspark.sql import functions as F

from spindle.operators import drift
from spindle.plans import streams
from spindle.session import scratch_path
from spindle.sources import fixtures
from spindle.streaming import online
from tests.conftest import SF


def test_window_stream_matches_batch(spark):
    got = {(r.window_start, r.disk_id): (r.num_io, r.size_sum) for r in streams.window_stream(spark, SF).collect()}
    rows = online.with_event_time(fixtures.replayed(spark, SF))
    batch = online.window_characteristics(rows, "1 hour").collect()
    want = {(r.window_start, r.disk_id): (r.num_io, r.size_sum) for r in batch}
    assert got.items() <= want.items()
    assert len(got) > 0.95 * len(want)  # only the newest windows stay open


def test_online_ends_match_batch(spark):
    rows = drift.index_series(fixtures.series(spark, "/root/testdata/sf0.01"), "hour")
    settings = drift.DriftSettings(threshold=4, offset=4, stability=5)
    want = {(r.idx, r.stability) for r in drift.concept_ends(drift.stability(rows, settings), settings).collect()}
    got = {(r.end_idx, r.stability) for r in streams.online_concept_ends(spark, "/root/testdata/sf0.01").collect()}
    last = rows.count() - 1
    assert got == {w for w in want if w[0] < last - 9}  # the newest rows still wait for those after them
    assert len(got) > 20


def test_a_repeated_batch_replaces_its_own_output(spark):
    path = scratch_path(spark, "late-in")
    spark.createDataFrame([(float(t),) for t in (0, 10, 20)], "ts_record double").coalesce(1).write.parquet(path)
    on_time, late, marks = (scratch_path(spark, n) for n in ("on", "late", "marks"))
    for run in range(2):  # a new checkpoint starts again at batch 0
        stream = spark.readStream.schema("ts_record double").parquet(path)
        online.split_late(stream, 50, 30, on_time, late, marks, scratch_path(spark, f"state-{run}")).awaitTermination()
    assert spark.read.parquet(on_time).count() == 3


def test_late_rows_go_to_the_side_table(spark):
    got = {r.is_late: r.n for r in streams.late_rows(spark, SF).collect()}
    assert got[False] + got[True] == fixtures.trace(spark, SF).count()
    assert 0 < got[True] <= 20


def test_scored_batches(spark):
    got = streams.scored_batches(spark, SF)
    assert {r.model for r in got.collect()} == {"m0", "m1", "m2"}
    assert got.agg(F.sum("num_io")).first()[0] == fixtures.prediction(spark, SF).count()
