"""Near-duplicates of the pipeline against the Jaccard similarity of all pairs."""

import random
import tracemalloc
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import simhash
from spindle.llm.graph import components
from spindle.llm.minhash import band_keys, linked_nodes, merged, prefix_keys, set_keys
from tests.conftest import SF


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    """Least id of each component of documents with a similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_made_up_copies(spark, documents):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size, changed in ((300, 1), (300, 5), (1000, 5), (1000, 20), (1000, 60), (40, 1), (8, 1)):
        for _ in range(10):
            base = rng.choices(words, k=size)
            copy = list(base)
            for i in rng.sample(range(size), changed):
                copy[i] = "other"
            texts += [" ".join(base), " ".join(copy).upper()]
    hot = rng.choices(words, k=200)
    for _ in range(60):  # a group of near copies, not all of which are near to each other
        copy = list(hot)
        for i in rng.sample(range(200), rng.randint(0, 6)):
            copy[i] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", None, "two words", "two words", "Two  words"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = corpus_pipeline.near_dedup(spark, documents(rows), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == slow_kept(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == want


def test_open_keys_meet_by_their_rare_members(spark):
    """Sets that all share a key: few are linked, some only to a set that is no head; half of each is one passage."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 63, 40, np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 40, np.uint64)])) for _ in range(30)]
    for i in range(0, 30, 3):
        for changed in (4, 8):
            copy = sets[i].copy()
            copy[rng.choice(len(copy), changed, replace=False)] = rng.integers(0, 1 << 63, changed, np.uint64)
            sets.append(np.unique(copy))
    sets += [passage[:1], passage[:2]]
    held = [set(x.tolist()) for x in sets]

    def jaccard(a, b):
        return len(held[a] & held[b]) / len(held[a] | held[b])

    want = {frozenset(p) for p in combinations(range(len(sets)), 2) if jaccard(*p) >= 0.8}
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, set binary")
    shared = nodes.select("node", F.lit(1).cast("long").alias("key"), F.lit(0).cast("long").alias("head"))
    asked = []

    def verified(pairs):
        rows = [tuple(r) for r in pairs.select("a", "b").collect()]
        asked.extend(rows)
        return spark.createDataFrame([p for p in rows if jaccard(*p) >= 0.8], "a long, b long")

    got = linked_nodes(shared, verified, nodes, 0.8, lambda m, n: 0.8 / 1.8 * (m + n), full=4)
    root = {r["node"]: r["root"] for r in got.collect()}
    linked = spark.createDataFrame([tuple(sorted(p)) for p in want], "a long, b long")
    expected = {r["node"]: r["root"] for r in components(linked).collect()}
    groups = [{frozenset(n for n in x if x[n] == r) for r in x.values()} for x in (root, expected)]
    assert groups[0] == groups[1] and len(asked) < 4 * len(sets)


def test_no_open_keys(spark):
    none = spark.createDataFrame([], "node long, key long, head long")
    sets = spark.createDataFrame([], "node long, set binary")
    assert linked_nodes(none, lambda pairs: pairs, sets, 0.8, lambda m, n: 0.8 * F.greatest(m, n)).count() == 0


def test_counts_of_members_are_no_objects_in_the_driver(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i, rng.integers(0, 1 << 63, 20_000, np.uint64).tobytes()) for i in range(8)]
    sets = spark.createDataFrame(rows, "node long, root long, set binary").localCheckpoint()
    tracemalloc.start()
    try:
        prefix_keys(sets, 0.8)
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    assert peak < 24, peak  # the counts themselves have 4 MB


def test_close_copies_meet_under_golay_keys(spark, documents, monkeypatch):
    """Op1's keys alone, without any MinHash key, link copies within two bits whose sets are similar enough."""
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        base = rng.choices([f"w{i}" for i in range(4000)], k=1500)
        texts += [" ".join(base), " ".join([*base[:700], "other", *base[701:]])]
    texts += ["one two three", "one two three four", None, ""]
    monkeypatch.setattr(simhash, "shared_keys", lambda keyed: keyed.limit(0).selectExpr("node", "key", "node AS head"))
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(list(enumerate(texts))), SF).collect()}
    far = {i for i in range(0, 80, 2) if bin((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])) & (2**64 - 1)).count("1") > 2}
    assert len(far) < 30 and got == set(range(0, 80, 2)) | {i + 1 for i in far} | {80, 81, 82}


def test_keys_of_one_set_are_those_of_many():
    rng = np.random.default_rng(3)
    for size in (1, 127, 128, 129, 1000):
        found = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        assert (set_keys(found, 30, 6) == band_keys(found, np.zeros(1, int), 30, 6)[0]).all()


def test_links_are_merged_into_components(spark):
    links = [(1, 2), (3, 4), (5, 6), (8, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    roots = merged(merged(components(frame(links)), frame([(2, 3), (10, 11)])), frame([(4, 11), (1, 3)]))
    groups = {}
    for r in roots.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 10, 11], [5, 6], [8, 9]]
