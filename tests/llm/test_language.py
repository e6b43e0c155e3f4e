import random
import zlib

import numpy as np

from spindle.llm import language
from spindle.llm.queries import QUERIES
from tests.conftest import SF


def test_codewords_differ_in_half_of_the_places():
    for n in (2, 3, 4, 9, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) * 2 >= min(code.shape[1], language.codewords(n).shape[1]) * 0.8


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(lang) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held) > 30
    assert not any(r["ambiguous"] for r in got)


def test_odd_rows(spark, documents):
    rng = random.Random(5)
    kinds = {"aa": "abcdef", "bb": "ghijkl", "cc": "éßñøåü"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(20)), k) for i, k in enumerate(list(kinds) * 30)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "aa"), (None, rows[0][1], "bb"), (1003, "abcdef " * 40_000), (1004, "ÉSSÑØÅ éñøåü")]
    odd += [(1005, "abc ghi abc ghi def jkl"), (3, rows[3][1], "aa")]
    docs = documents(rows + odd).selectExpr("*", "1 as lang_pred", "2 as score", "3 as held_out", "4 as p")
    got = [r for r in language.identify(docs).collect() if r["doc_id"] is None or r["doc_id"] >= 1000]
    found = {r["doc_id"]: (r["lang_pred"], r["ambiguous"]) for r in got}
    assert all(found[d] == ("und", True) for d in (1000, 1001, 1002))
    assert found[None] == found[1003] == ("aa", False) and found[1004] == ("cc", False)
    assert min(r["score"] for r in got if r["doc_id"] not in (1000, 1001, 1002)) == next(r["score"] for r in got if r["doc_id"] == 1005)
    assert language.identify(docs.limit(0)).count() == 0
    untaught = language.identify(documents([(1, "text"), (2, "more")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in untaught] == [("und", 0.0)] * 2
    alone = language.identify(documents([(i, "some text", "xx") for i in range(9)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("xx", 1.0)}


def test_held_out_rows_and_labels_do_not_matter(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    first = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(rows)).collect()}
    blind = [(d, t, None if zlib.crc32(str(d).encode()) % 3 == 1 else k, None) for d, t, k, _ in rows]
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(blind)).collect()} == first
