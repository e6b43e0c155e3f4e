import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spindle.llm import mixing
from spindle.llm.queries import QUERIES
from tests.conftest import SF


def slow_targets(sizes):
    """Share by weight; whatever is above its limit stops there, and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        total = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / total for s in order}
        above = {s for s in order if s not in stopped and target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        stopped |= above


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def checked(rows, got, slack):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want, taken = slow_targets(sizes), Counter()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len(words(t))) for d, t, s in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= slack(target), (source, taken[source], target)


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 300, "é": 2, None: 7, "z": 0}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    want = slow_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_permutation(spark):
    for n in (1, 2, 3, 64, 1000):
        got = spark.range(n).withColumn("n", F.lit(n).cast("long")).select(mixing.permuted("id", "n", "5, 7").alias("x"), "id").collect()
        assert sorted(r["x"] for r in got) == list(range(n))
        if n == 1000:
            assert sum(r["x"] == r["id"] for r in got) < 30
            other = spark.range(n).withColumn("n", F.lit(n).cast("long")).select(mixing.permuted("id", "n", "5, 8").alias("x")).collect()
            assert [r["x"] for r in got] != [r["x"] for r in other]


def test_query_comes_near_its_targets(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    run = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    checked(rows, run, lambda target: 130)
    got = QUERIES["op7_mix_sources"](spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter((r["doc_id"], r["taken"]) for r in got.collect()) == Counter((r["doc_id"], r["taken"]) for r in run)


def test_odd_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, f"word{i} " * (i % 9), "hot") for i in range(200)] + [(i, "x y\tz", "small") for i in range(200, 204)]
    rows += [(300, None, None), (301, "of no source " * 30, None), (None, "without id", "hot"), (302, "", "empty"), (303, "long " * 20_000, "b")]
    rows += [(5, "repeated row here", "b")] * 2 + [(5, "another text", "b")]
    docs = documents([(d, t, None, s) for d, t, s in rows]).withColumn("size", F.lit(1)).withColumn("sid", F.lit("x"))
    checked(rows, mixing.mix(docs, block_words=8, shard_slots=64).collect(), lambda target: 8 * 12 + 0.01 * target)
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(documents([(1, None, None, "a"), (2, " ", None, "b")])).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in nothing) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_mixed_documents_hold_the_words_that_are_taken(spark, documents):
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(i % 40)), None, f"s{i % 5 // 2}") for i in range(300)]
    docs = documents(rows).withColumn("extra", F.lit(1)).withColumn("size", F.lit(2)).withColumn("sid", F.lit("x")).withColumn("row", F.lit(3))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=16).collect()}
    made = mixing.mixed_documents(docs, block_words=16)
    assert made.columns == docs.columns
    texts, total = {d: t.split(" ") for d, t, *_ in rows}, Counter()
    for r in made.collect():
        own = r["text"].split(" ")
        rest = iter(texts[r["doc_id"]])
        assert all(w in rest for w in own) and r["n_chars"] == len(r["text"])  # a subsequence
        total[r["doc_id"]] += len(own)
    assert total == Counter({d: n for d, n in taken.items() if n})
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
