import random
import zlib

import numpy as np

from spindle.llm import quality
from spindle.llm.queries import QUERIES
from tests.conftest import SF

SF001 = SF.replace("sf0.001", "sf0.01")


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_cover_whole_texts():
    base = "Word one two. " * 3000
    names = list(quality.STATISTICS)
    a, b = quality.statistics(base), quality.statistics(base + "#" * 20_000)
    assert a[names.index("sign")] == 0 < b[names.index("sign")] and len(a) == len(names)
    assert (quality.statistics("") == 0).all() and np.isfinite(quality.statistics(" \n\t é")).all()
    x = quality.statistics("ABC abc 1!\nabc abc 1!")
    assert np.isclose(x[names.index("upper")] ** 2, 3 / 21) and x[names.index("lines")] == np.log1p(2) and x[names.index("distinct_lines")] == 1
    assert x[names.index("repeated_word")] == 1 / 6 and x[names.index("distinct_words")] == 3 / 6


def test_isotonic_against_min_max():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 30)
        count, at = rng.integers(1, 9, n).astype(float), np.arange(n) / 10
        good = np.array([rng.binomial(c, p) for c, p in zip(count.astype(int), np.linspace(0.1, 0.9, n))], float)
        x, share = quality.isotonic(at, good, count)
        # the closest rising curve: the least over later ends of the largest over earlier starts of the means
        want = [max(min(good[i : j + 1].sum() / count[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        pools = [np.flatnonzero(np.isclose(want, v)) for v in sorted(set(np.round(want, 12)))]
        assert np.allclose(share, [(good[p].sum() + 0.5) / (count[p].sum() + 1) for p in pools])
        assert np.allclose(x, [(at[p] * count[p]).sum() / count[p].sum() for p in pools])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    old = quality.FEATURES
    try:
        quality.FEATURES = 40_000
        fourier = quality.Fourier(np.zeros(6), np.ones(6))
        x = rng.uniform(-3, 3, (20, 6))
        z = fourier.features(x)[:, :-1]
        far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        assert np.abs(z @ z.T - np.exp(-far / (2 * quality.WIDTH**2))).max() < 0.03
    finally:
        quality.FEATURES = old


def test_fit_against_brute_force(spark, documents):
    """Sums of partitions, halves and salts give what one least-squares fit over all rows gives."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "LOUD!!", "of.", "x#", "ing"], weights=[5, i % 3, 3, i % 2, 4], k=rng.randrange(1, 40)))) for i in range(400)]
    marks = [(i, int(i % 3 == 0), 0) for i in range(0, 400, 2)]
    rows += [(4, "again 4"), (4, "again 4"), (None, "none")]
    stats = quality.with_statistics(documents(rows, 7))
    learned = quality.labelled(stats, labels(spark, marks))
    y = dict((d, float(q)) for d, q, _ in marks if remainder(d))
    used = [(d, t) for d, t in rows if d in y]
    fourier = quality._scaling(learned)
    x = np.array([quality.statistics(t) for _, t in used])
    assert np.allclose(fourier.mean, x.mean(axis=0)) and np.allclose(fourier.spread, np.maximum(x.std(axis=0), 1e-3))
    z, target = fourier.features(x), np.array([y[d] for d, _ in used])
    penalty = np.sqrt(quality.RIDGE * len(used))
    stacked = np.vstack([z, np.diag([penalty] * quality.FEATURES + [np.sqrt(1e-9 * len(used))])])
    want = np.linalg.lstsq(stacked, np.concatenate([target, np.zeros(z.shape[1])]), rcond=None)[0]
    got = quality.solve(quality.normal_equations(learned, fourier).sum(axis=0))
    assert np.allclose(z @ got, z @ want, atol=1e-6)


def test_held_out_accuracy(spark):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    got = QUERIES["op11_quality_classifier"](spark, SF001).collect()
    assert len(got) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert all(0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (remainder(r["doc_id"]) == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in good]
    assert len(held) > 50 and sum(r["predicted"] == good[r["doc_id"]] for r in held) >= 0.9 * len(held)
    low = [r["score"] for r in held if not good[r["doc_id"]]]
    high = [r["score"] for r in held if good[r["doc_id"]]]
    assert np.mean([a < b for a in low for b in high]) > 0.97


def test_only_texts_and_learning_labels_matter(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    marks = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    first = {r["doc_id"]: r["score"] for r in quality.scored_documents(documents(rows), labels(spark, marks)).collect()}
    turned = [(d, q if remainder(d) else 1 - q, 1 - t) for d, q, t in marks]
    blind = [(d, t, None, None) for d, t, _, _ in rows]
    again = {r["doc_id"]: r["score"] for r in quality.scored_documents(documents(blind, 5), labels(spark, turned)).collect()}
    assert again.keys() == first.keys() and max(abs(again[d] - first[d]) for d in first) < 1e-5


def test_odd_rows(spark, documents):
    rows = [(i, "Plain words of a text. " * (i % 9 + 1) if i % 2 else "LOUD!! NOISE!! " * (i % 9 + 1)) for i in range(200)]
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, "Plain words of a text."), (1003, "LOUD!! NOISE!! " * 30_000), (3, rows[3][1]), (3, rows[3][1])]
    docs = documents(rows + odd).selectExpr("*", "1 as stats", "2 as salt", "3 as quality", "4 as score")
    marks = [(i, i % 2, 0) for i in range(200)] + [(3, 1, 0), (3, 1, None), (None, 0, 0), (5, None, 0), (1001, None, 1), (9999, 0, 0)]
    got = quality.scored_documents(docs, labels(spark, marks).selectExpr("*", "1 as y", "'x' as text", "1 as salt")).collect()
    assert len(got) == len(rows + odd) and all(0 < r["score"] < 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1000] == score[1001] and score[1003] < 0.3 < score[None] and not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert quality.scored_documents(docs.limit(0), labels(spark, marks)).count() == 0
    bare = quality.scored_documents(documents(rows), labels(spark, marks).limit(0)).collect()
    assert {r["score"] for r in bare} == {0.5}
    one_sided = quality.scored_documents(documents(rows), labels(spark, [(i, 1, 0) for i in range(100)])).collect()
    assert all(r["predicted"] == 1 for r in one_sided)


def test_labels_are_not_gathered_on_the_driver(spark, documents):
    """Few bytes of labels become ``SALTS`` times as many rows; Spark does not see that and would broadcast them."""
    stats = quality.with_statistics(documents([(i, f"text {i}") for i in range(50)] + [(3, "again"), (None, "none")]))
    means = labels(spark, [(i, i % 2, 0) for i in range(0, 60, 2)] + [(3, 1, 0)]).selectExpr("doc_id", "double(quality) as y")
    met = quality._met(stats, means)
    assert sorted(r["doc_id"] for r in met.collect()) == sorted([*range(0, 50, 2), 3, 3])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
