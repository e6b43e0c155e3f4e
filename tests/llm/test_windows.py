"""Repeated windows of 50 words: what is left of them, whatever sentences they lie in."""

import random
import re

from spindle.llm import spans
from tests.conftest import SF


def repeated_windows(rows, size=50):
    """(document, place) of every window of so many words, ten different ones at least, that occurs before."""
    seen, found = set(), []
    for d, text in sorted(rows):
        words = re.findall(r"\S+", text.lower())
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen and len(set(key)) >= 10:
                found.append((d, i))
            seen.add(key)
    return found


def test_passages_in_long_sentences(spark, documents):
    """A passage without any mark is found wherever it begins: all but its ragged ends go."""
    rng = random.Random(41)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=300))
    rows = []
    for d in range(12):
        before, after = (" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(2))
        rows.append((d, f"{before} {passage} {after}"))
    got = {r["doc_id"]: r["text"] for r in spans.without_repeats(documents(rows)).collect()}
    assert got[0] == rows[0][1]
    for d, text in rows[1:]:
        own = set(text.split()) - set(passage.split())
        assert own <= set(got[d].split()) and len(got[d].split()) <= len(text.split()) - 200


def test_windows_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r["doc_id"], r["text"]) for r in spans.without_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    before, after = repeated_windows(rows), repeated_windows(got)
    print(len(before), len(after))
    assert len(before) > 1000 and len(after) <= 0.005 * len(before)
