import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import decontaminate, language, mixing, simhash
from spindle.session import scratch_path
from tests.conftest import SF
from tests.llm.test_similarity import slow_kept
from tests.llm.test_tokens import whole

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, documents):
    """Each stage on its own input; the rows that the run returns are those of the stages one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    extra = documents([(900, None), (901, ""), (902, "12 34 !"), (None, "a text of no id and of no source at all, und mehr")], 1)
    folder = scratch_path(spark, "test-pipeline")
    docs.union(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in at.collect()]
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        after_df = spark.read.parquet(f"{folder}/{name}")
        after = [tuple(r) for r in after_df.collect()]
        if name != "token_output":
            assert after_df.columns == COLUMNS
        if name == "language_id":
            gone = Counter(before) - Counter(after)
            assert {r[0] for r in gone} == {900, 901, 902} and len(after) == len(before) - 3
        if name == "near_dedup":
            some = [(r[0] if r[0] is not None else 10**9, r[1]) for r in before]
            assert sorted(r[0] if r[0] is not None else 10**9 for r in after) == slow_kept(some) and not Counter(after) - Counter(before)
        if name == "decontaminate":
            assert Counter(after) == Counter(r for r in before if not any(f" {i} " in f" {decontaminate.normalise(r[1])} " for i in items))
        if name == "mix_sources":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(at).collect()}
            made = Counter()
            for r in after:
                made[r[0]] += len(r[1].split())
            assert made == Counter({d: n for d, n in taken.items() if n})
        if name == "token_output":
            want = Counter((r[0], len(ids := [*whole(r[1]), 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in before)
            assert Counter((d, n, c) for d, _, n, c in after) == want
            starts = sorted((s, n) for _, s, n, _ in after)
            assert all(s + n == t for (s, n), (t, _) in zip(starts, starts[1:])) and starts[0][0] == 0
        at = after_df
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, at.collect()))


def test_odd_rows(spark, documents):
    rows = [(1, "the same text of some words", "en", "a"), (1, "the same text of some words", "en", "a"), (1, "the same text of some words", "en", "b")]
    rows += [(None, "the same text of some words"), (None, None), (2, ""), (None, "wholly other words are written here instead"), (None, "wholly other words are written here instead")]
    docs = documents(rows).withColumn("fp", F.lit(1)).withColumn("row", F.lit("x"))
    got = sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, "the same text of some words"), (2, "")]
    rest = [r["text"] for r in simhash.one_of_each(docs).collect() if r["doc_id"] is None]
    assert rest == ["wholly other words are written here instead"]
    assert language.known_language(docs).count() == 3 + 1 + 2 and language.known_language(docs).columns == docs.columns
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
