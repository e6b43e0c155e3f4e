import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from spindle.llm.exact import exact_duplicates


def slow(rows):
    bodies = [(d, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, b in bodies:
        groups.setdefault(b, []).append(d)
    out = []
    for d, b in bodies:
        keep = min((x for x in groups[b] if x is not None), default=None)
        out.append((d, keep, len(groups[b]), d == keep, sha256(b.encode()).hexdigest()))
    return Counter(out)


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (5, None), (4, ""), (6, " "), (None, "z"), (7, "é x"), (7, "é x"), (8, "y" * 300_000)]
ROWS += [(100 + i, "hot text") for i in range(50)]


def test_groups(spark, documents):
    docs = documents(ROWS).withColumn("digest", F.lit(1)).withColumn("n", F.lit("x"))
    got = exact_duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == slow(ROWS)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_equal_digests_of_different_texts_stay_apart(spark, documents):
    got = exact_duplicates(documents(ROWS), salts=2, digest=lambda body: F.length(body) % 2)
    assert Counter(map(tuple, got.collect())) == slow(ROWS)
