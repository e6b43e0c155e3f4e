import re
from collections import Counter
from hashlib import sha256

import xxhash

from spindle.llm import spans
from spindle.llm.queries import QUERIES
from tests.conftest import SF


def slow_pieces(text):
    """(start, end, lower-case words) of each sentence, or piece of one."""
    parts = []
    for m in re.finditer(r"[^.!?。！？\n]+[.!?。！？]*", text):
        words = [(m.start() + w.start(), m.start() + w.end(), w[0].lower()) for w in re.finditer(r"\S+", m[0])]
        if not words:
            continue
        if len(words) <= 20:
            parts.append((m.start(), m.end(), [w for _, _, w in words]))
            continue
        piece = []
        for w in words:
            if piece and (len(piece) == 40 or xxhash.xxh3_64_intdigest(w[2]) % 12 == 0):
                parts.append((piece[0][0], piece[-1][1], [x for _, _, x in piece]))
                piece = []
            piece.append(w)
        parts.append((piece[0][0], piece[-1][1], [x for _, _, x in piece]))
    return parts


def digests(text):
    """The order of rows that share an id, as the library has it."""
    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(text, 42),))


def slow(rows):
    """Walk over documents in order, remembering every run; (doc_id, sentences, removed, text) of each row.

    Rows that share an id but not the text are told apart; the tests have them only where their order does not matter.
    """
    seen, texts = set(), {}
    order = sorted({(d is None, d or 0, digests(t or ""), t or "") for d, t in rows})
    for null, d, _, t in order:
        parts = slow_pieces(t)
        gone = set()
        for i in range(len(parts)):
            j = i + 3
            while j <= len(parts):
                words = [w for p in parts[i:j] for w in p[2]]
                if len(words) >= 10 or sum(len(" ".join(p[2])) for p in parts[i:j]) >= 60:
                    run = " ".join(words)
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
                    break
                j += 1
        left, done = "", 0
        for i, (a, b, _) in enumerate(parts):
            if i in gone:
                left += t[done:a]
                done = b
        texts[null, d, t] = (len(parts), len(gone), left + t[done:])
    return Counter((d, *texts[d is None, d or 0, t or ""]) for d, t in rows)


PASSAGE = "The first long sentence of a passage has eleven words here. A second one follows it with some more words inside! And a third?\nA fourth ends it."


def test_runs_and_removal(documents, monkeypatch):
    salad = " ".join(f"w{i}" for i in range(75))
    rows = [
        (1, f"Start here. {PASSAGE} Own end."),
        (2, f"Other words. {PASSAGE.upper()} More of it. Nd."),
        (3, f"{PASSAGE} {PASSAGE}"),
        (4, f"no stops {salad}"),
        (5, f"no stops {salad}"),
        (6, "Nd. Of. The. Nd. Of. The."),
        (7, "Nd. Of. The."),
        (8, None),
        (9, ""),
        (10, " \n "),
        (11, "é" * 100_000 + ". " + PASSAGE),
        (13, "一二三四五六七八九十一二三四五六七八九十。" + "你好世界你好世界你好世界你好世界你好世界。" + "今天天气很好今天天气很好今天天气很好。"),
        (14, "开始。一二三四五六七八九十一二三四五六七八九十。你好世界你好世界你好世界你好世界你好世界。今天天气很好今天天气很好今天天气很好。"),
        (15, "Nd.!! " * 40 + "A.!! B.!! C.!! D.!! E.!! F.!! G.!! H.!! I.!! J.!! K.!! L.!!"),
        (16, "Other. A.!! B.!! C.!! D.!! E.!! F.!! G.!! H.!! I.!! J.!! K.!! L.!!"),
        (12, "the same row twice and more words to make it long enough for a run. yes! it is so now, is it not? so."),
        (12, "the same row twice and more words to make it long enough for a run. yes! it is so now, is it not? so."),
    ]
    docs = documents(rows).selectExpr("*", "1 as m1", "2 as spans", "3 as start", "4 as salt", "5 as h1", "6 as id")
    got = spans.without_repeats(docs)
    assert Counter(map(tuple, got.collect())) == slow(rows)
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    assert kept[14] == "开始。" and kept[16] == "Other." and kept[6].startswith("Nd. Of.") and "fourth" not in kept[2] and kept[3].count("fourth") == 0 and kept[12].startswith("the same")
    monkeypatch.setattr(spans, "HOT", 2)  # most hashes are hot ones now
    assert Counter(map(tuple, spans.without_repeats(docs).collect())) == slow(rows)
    assert spans.without_repeats(docs.limit(0)).count() == 0
    odd = documents([(None, PASSAGE), (5, PASSAGE)])
    assert {r["doc_id"]: r["n_removed"] for r in spans.without_repeats(odd).collect()} == {5: 0, None: 4}


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((d, n, gone, len(t), sha256(t.encode()).hexdigest()) for (d, n, gone, t) in slow(rows).elements())
    got = QUERIES["op10_substring_dedup"](spark, SF)
    assert Counter(map(tuple, got.collect())) == want
