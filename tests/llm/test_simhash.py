import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spindle.llm import simhash
from spindle.llm.queries import QUERIES
from tests.conftest import SF


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints))


def test_every_word_within_three_bits_of_one_codeword():
    patterns = simhash.near_patterns()
    assert all(len(set(p)) in (1, 6) for p in patterns.tolist())
    assert max(int(p[0]).bit_count() for p in patterns.tolist()) == 3


def test_keys_meet_within_two_bits():
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 2))) for x in a]
    _, looked = simhash.golay_keys(np.array(a, np.uint64))
    filed, _ = simhash.golay_keys(np.array(b, np.uint64))
    assert all(set(x) & set(y) for x, y in zip(looked.tolist(), filed.tolist()))


def test_pairs_are_whole_with_and_without_full_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(5)]
    values = {x ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 4))) for x in base for _ in range(60)}
    want = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 2}
    prints = spark.createDataFrame([(x,) for x in values] + [(None,)], "fp long")
    for full in (200, 3):
        got = simhash.linked_pairs(prints, full).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_simhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == slow_components(rows)


def test_odd_rows(spark, documents):
    long = " ".join(f"w{i % 5000}" for i in range(70_000))
    rows = [(4, None), (2, ""), (7, " \t"), (None, "One two"), (9, "ONE\x0btwo"), (9, "one two"), (1, long), (3, long), (5, "é È x"), (6, "Z")]
    docs = documents(rows).withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs)
    assert Counter(map(tuple, got.collect())) == slow_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
