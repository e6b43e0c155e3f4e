import random

from spindle.llm import decontaminate as dc
from spindle.llm.queries import QUERIES
from tests.conftest import SF


def closest(item, text):
    """Least edit distance of ``item`` to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        item, text = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (90, 60))
        least, end = dc.Pattern(item).best(text)
        assert least == closest(item, text)
        assert least == closest(item, text[:end]) and (end == 0 or least < closest(item, text[: end - 1]))


def mutated(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "q" + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]])
    return text


def test_against_brute_force(spark, documents):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 14)))) for i in range(12)]
    rows = []
    for d in range(120):
        item = items[d % 12][1]
        passage = mutated(rng, item, rng.randint(0, 9))
        rows.append((d, " ".join(rng.choices(words, k=10)) + ". " + passage.upper() + ",\n" + " ".join(rng.choices(words, k=5))))
    got = dc.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, text in rows:
        for i, item in items:
            plain = dc.normalise(item)
            distance = closest(plain, dc.normalise(text))
            if distance <= int(len(plain) * dc.ERROR_RATE):
                want[d, i] = distance
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(got) == len(want) > 40
    texts = dict(rows)
    for r in got:  # the span holds the passage
        assert closest(dc.normalise(dict(items)[r["item_id"]]), dc.normalise(texts[r["doc_id"]][r["start"] : r["end"]])) == r["distance"]


def test_blocks_and_odd_rows(spark, documents):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(1, item), (2, item.upper() + "!"), (3, None), (4, ""), (5, "too short"), (6, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, f"x {item}"), (7, f"İ{item}"), (7, "Σ, One-two  three four five six seven..."), (8, "x" * 300_000 + " " + item), (9, "clean text here")]
    docs = documents(rows).selectExpr("*", "1 as item_id", "'x' as plain")
    for block in (dc.BLOCK_CHARS, 10):
        got = dc.contaminated(docs, bench, block_chars=block)
        assert sorted((r["doc_id"] or -1, r["item_id"], r["distance"]) for r in got.collect()) == sorted((d, i, 0) for d in (-1, 7, 7, 8) for i in (1, 2))
        kept = dc.clean_documents(docs, bench, block_chars=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 9] and kept.columns == docs.columns
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in got.collect()}
    assert spans[8] == (300_001, 300_001 + len(item))
    assert dc.contaminated(docs, bench.limit(0)).count() == dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_query_finds_the_items_that_occur_word_for_word(spark):
    items = [(r["item_id"], dc.normalise(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        plain = f" {dc.normalise(r['text'] or '')} "
        want |= {(r["doc_id"], i) for i, t in items if f" {t} " in plain}
    got = QUERIES["op8_benchmark_decontamination"](spark, SF).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == want
