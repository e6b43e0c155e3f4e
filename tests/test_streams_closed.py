"""Streams put out every window and session, the newest included."""

from spindle.plans import streams
from spindle.sources import fixtures
from spindle.streaming import online
from tests.conftest import SF

WINDOWS = """select window.start, disk_id, count(*), count_if(io_type = 1), sum(size)
from replayed group by window(timestamp_micros(cast(ts_record * 1000 as bigint)), {}), disk_id"""


def test_all_windows_and_sessions(spark):
    rows = fixtures.replayed(spark, SF)
    rows.createOrReplaceTempView("replayed")
    for stream, width in ((streams.window_stream, "'1 hour'"), (streams.sliding_stream, "'6 hours', '3 hours'")):
        got = [tuple(r) for r in stream(spark, SF).select("window_start", "disk_id", "num_io", "read_count", "size_sum").collect()]
        want = [tuple(r) for r in spark.sql(WINDOWS.format(width)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and want
    want = online.sessions(online.with_event_time(rows), "30 minutes").collect()
    assert sorted(map(str, streams.sessions(spark, SF).collect())) == sorted(map(str, want)) and want
