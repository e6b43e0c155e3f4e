import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindle.llm import alignment
from spindle.llm.queries import QUERIES
from tests.conftest import SF

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    table, n = {}, 0
    for b in range(256):
        if chr(b).isprintable() and b not in (32, 160, 173):
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return table


class Slow:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        table = letters()
        self.decode = lambda i: bytes(table[c] for c in self.a.id_to_token(i))

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ta, tb = [(i, self.decode(i)) for i in a], [(i, self.piece(i)) for i in b]
        raw = (" " + text).encode()
        return (ta, tb) if b"".join(t for _, t in ta) == raw == b"".join(t for _, t in tb) else ([], [])

    def run(self, rows):
        docs, counts = [], Counter()
        for doc_id, text in rows:
            spans = []
            for tokens in self.tokens(text):
                at, own = 0, []
                for i, t in tokens:
                    own.append((i, at, at + len(t)))
                    at += len(t)
                spans.append(own)
            a, b = spans
            links, j = [], 0
            for i, s, e in a:
                while j and b[j][1] > s:
                    j -= 1
                while b[j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < e:
                    links.append((i, b[k][0]))
                    k += 1
            ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups = []
            for lo, hi in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) if len(a) < 400 else None)
            docs.append((doc_id, len(a), len(b), ends, links, groups))
            counts.update(links)
        most = Counter()
        for (_, y), n in counts.items():
            most[y] = max(most[y], n)
        out = []
        for doc_id, na, nb, ends, links, groups in docs:
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if na and None not in groups else "" if not na else None
            out.append((doc_id, na, nb, len(ends), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
        return out, counts


@pytest.fixture(scope="module")
def slow():
    return Slow()


def same(got, want):
    """Digests of long texts are left to the test of words against whole texts."""
    long = {r[0] for r in want if r[-1] is None}
    cut = [tuple(r[:-1]) if r[0] in long else tuple(r) for r in got]
    return Counter(cut) == Counter(r[:-1] if r[-1] is None else r for r in want)


ODD = [
    "", " ", "  ", "\n", "a  b", "word ", " lead", "tab\tin\tside", "line\nbreak", "two\n\nbreaks\n", "x \n y", "it's we'll <|endoftext|> <s> </s> <unk>", "日本語のテキスト。次の文。",
    "a▁b", "😀 é́ ﬁ ①", "nul\x00l", " nbsp sep", "{\r\n}\r\n\t;\r", "a" * 3000, "!?" * 500, "\x1c x\x85y", "0123456789 3.14", "É" + "́" * 50, "a​b﻿c", "<0x0A> ▁",
]


def test_words_stand_for_whole_texts(slow):
    own = alignment.Aligner(*PATHS)
    rng = random.Random(3)
    pieces = ODD + ["the", "thandou.", "Ente\n", "ß", "  ", "\t", "\r\n", "\n", " ", "'s", "<|endoftext|>", "ing\nThe", "　"]
    texts = ODD + ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(2500)] + [" ".join(rng.choices(pieces, k=9)) for _ in range(1000)]
    own.most = 900  # all are learned at first, then forgotten from time to time
    for i in range(0, len(texts), 500):
        own.words(texts[i : i + 500])
    for text in texts:
        numbers, _ = own.words([text])
        a, b = slow.tokens(text)
        assert own.sizes[numbers, 0].sum() == len(a) and own.sizes[numbers, 1].sum() == len(b), repr(text)
        spelled = ";".join(own.groups[i] for i in numbers)
        if len(numbers):
            groups = [g.split("|") for g in spelled.split(";")]
            assert ",".join(g[0] for g in groups) == ",".join(str(i) for i, _ in a), repr(text)
            assert ",".join(g[1] for g in groups) == ",".join(str(i) for i, _ in b), repr(text)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2047, 2048, 30_000):
        places = np.sort(rng.choice(alignment.RANGE, n, replace=False))
        assert (alignment.expand(alignment.compress(places)) == places).all()
    pairs = rng.integers(0, 5, 4000)
    places, times = np.arange(4000), rng.integers(1, 40, 4000)
    half = alignment.bitmaps(pairs[:2500], places[:2500], times[:2500]), alignment.bitmaps(pairs[2500:], places[2500:], times[2500:])
    for pair in range(5):
        merged = alignment.merge([planes[list(found).index(pair)] for found, planes in half])
        seen = np.zeros(alignment.RANGE, int)
        for k, plane in enumerate(merged):
            seen[alignment.expand(plane)] += 1 << max(k - 1, 0)
        want = np.zeros(alignment.RANGE, int)
        want[places[pairs == pair]] = times[pairs == pair]
        assert (seen == want).all()


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(documents, slow, small, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["the", "thandou", "ing.", "Ente", "éauon", "x\ny", "<|endoftext|>", "日本"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, "again the"), (5, "again the"), (None, "the ing."), (None, None), (2000, None)]
    docs = documents(rows).selectExpr("*", "1 as pair", "2 as place", "3 as n_a", "4 as links")
    if small:  # many part bitmaps, words forgotten, scores joined by a shuffle
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 1)
        found = alignment.align(docs, entries=40, words=20)
    else:
        found = alignment.align(docs)
    want, counts = slow.run(rows)
    assert same(found.scored_documents().select(*COLUMNS).collect(), want)
    scores = {(r["a"], r["b"]): r["links"] for r in found.scores.collect()}
    assert scores == counts
    held = Counter((x, y) for _, t in rows for (x, y) in slow.run([(0, t)])[1])
    assert {(r["a"], r["b"]): r["documents"] for r in found.scores.collect()} == held
    assert alignment.aligned_documents(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, slow):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = slow.run(rows)
    got = QUERIES["op12_tokenizer_alignment"](spark, SF).select(*COLUMNS).collect()
    assert len(got) == len(rows) and same(got, want)
