"""Readers and writers on small files."""

import io
import tarfile

from pyspark.sql import functions as F

from spindle.functions.scalars import duration_minutes, duration_minutes_column
from spindle.sources import readers, writers


def test_read_archives_and_plain_files_agree(spark, tmp_path):
    lines = [f"{i}.5 {i % 3} {i * 4096} 512 {i % 2}" for i in range(250)]
    plain = tmp_path / "trace.csv"
    plain.write_text("\n".join(lines))
    archive = tmp_path / "trace.tar.gz"
    with tarfile.open(archive, "w:gz") as out:
        for n, part in enumerate((lines[:100], lines[100:])):
            data = "\n".join(part).encode()
            info = tarfile.TarInfo(f"chunk_{n}.csv")
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    a = readers.read_trace(spark, str(plain))
    bare = tmp_path / "trace.tar"
    with tarfile.open(bare, "w") as out:
        out.add(plain, arcname="deep/trace.csv")
        out.addfile(tarfile.TarInfo("deep/empty.csv"))
    mixed = readers.read_trace(spark, [str(plain), str(archive), str(bare)])
    assert mixed.count() == 750 and mixed.distinct().exceptAll(a).count() == 0
    b = readers.read_trace(spark, [str(archive)])
    assert a.exceptAll(b).count() == 0 and b.count() == 250


def test_tencent_flags_and_rejects(spark):
    rows = [(1.5, 8, 2, 0, 7), (2.0, 16, 4, 1, 7), (2.5, 1, 1, 2, 7), (None, 1, 1, 0, 7)]
    good, bad = readers.standardize_tencent(spark.createDataFrame(rows, readers.TENCENT))
    got = sorted(tuple(r) for r in good.collect())
    assert got == [(1500.0, 7, 4096, 1024, 1), (2000.0, 7, 8192, 2048, 0)]
    assert bad.count() == 2


def test_tectonic_layouts(spark, tmp_path):
    texts = {
        2019: "# a\n# b\n3 10 20 100.5 1 p ns u\n4 0 8 101.0 3 p ns u\n",
        2021: "# a\n# b\n3 10 20 100.5 5 ns u host 1\n",
        2023: "# a\n# b\n3 10 20 100.5 6 ns u shard 1 host\n",
    }
    for year, text in texts.items():
        (tmp_path / f"{year}.trace").write_text(text)
        rows = readers.read_tectonic(spark, str(tmp_path / f"{year}.trace"), year).where(F.col("block_id").isNotNull())
        got = sorted(readers.standardize_tectonic(rows).drop("file").collect())
        first = got[0]
        assert (first.ts_record, first.offset, first["size"]) == (0.0, 3 * 8388608 + 10, 20)
        assert first.disk_id == ("ns" if year == 2019 else "host")
        assert first.io_type == (0 if year == 2023 else 1)


def test_tectonic_keeps_every_record(spark, tmp_path):
    text = "# a\n# b\n3 10 20 100.5 5 ns u host 1\nbroken line\n4 10 20 x 5 ns u host 1\n\n5 0 8 101.5 1 ns u host 1\n6 0 8 102.5 1 ns u host 1 2\n"
    (tmp_path / "2021.trace").write_text(text)
    rows = readers.read_tectonic(spark, str(tmp_path), 2021)
    for some in (rows, rows.select("op_name"), rows.select("file"), rows.select("block_id", "host_name")):
        assert len(some.collect()) == some.count() == 2
    assert sorted(r.block_id for r in rows.collect()) == [3, 5]
    bad = readers.rejected_tectonic(spark, str(tmp_path), 2021)
    assert sorted(r.value for r in bad.collect()) == ["4 10 20 x 5 ns u host 1", "6 0 8 102.5 1 ns u host 1 2", "broken line"]
    assert bad.count() == 3
    (tmp_path / "2021.trace").write_text("# a\n")
    assert rows.count() == bad.count() == 0


def test_replayed_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,10,1,512,0,1.5,512\n")
    (tmp_path / "b.csv").write_text("1.0,10,1,512,0,1.5,3,2.5\n")
    got = {r.device: (r.ts_submit, r.size_after_replay, r.ts) for r in readers.read_replayed(spark, str(tmp_path)).collect()}
    assert got == {None: (1.5, 512, None), 3: (1.5, None, 2.5)}


def test_window_list(spark, tmp_path, group_rows):
    text = "# note\n\n! first\n1: w1 # tail\nbare\n2x:  w2\nother\n! second\nw9\n"
    (tmp_path / "list.txt").write_text(text)
    got = sorted((r.group, r.ord, r.key, r.name) for r in readers.read_window_lists(spark, str(tmp_path / "list.txt")).collect())
    assert got == [("first", 0, "1", "w1"), ("first", 1, "0", "bare"), ("first", 2, "2x", "w2"), ("first", 3, "1", "other"), ("second", 0, "0", "w9")]


def test_drift_paths(spark):
    paths = ["/x/gradual/10_99/done", "/x/1.5/3_4/a.csv", "/x/none"]
    kind, span = readers.drift_of_path(F.col("p"))
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(kind.alias("k"), span.alias("s")).collect()
    assert [(r.k, r.s) for r in got] == [("gradual", "10_99"), ("1.5", "3_4"), ("", "")]


def test_window_files_keep_all_rows(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 3).alias("disk_id"), F.floor(F.col("id") / 50).alias("window_id"), F.col("id").cast("double").alias("ts_record"))
    writers.write_windows(df, str(tmp_path / "w"), windows_per_folder=4)
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.count() == 500
    assert back.where((F.col("disk_id") == 1) & (F.col("window_id") == 3)).count() == 17


def test_durations(spark):
    texts = {"90": 90, "10m": 10, "10min": 10, "2hours": 120, "3hr": 180, "1d": 1440, "2days": 2880}
    got = spark.createDataFrame([(t,) for t in [*texts, "soon"]], "t string").select("t", duration_minutes_column(F.col("t")).alias("m"))
    assert {r.t: r.m for r in got.collect()} == {**texts, "soon": None}
    assert all(duration_minutes(t) == m for t, m in texts.items())
