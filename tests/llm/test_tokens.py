import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm import tokens
from spindle.session import scratch_path

TOKENIZER = Tokenizer.from_file(tokens.default_tokenizer())


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", " \t\n", "Don't STOP, it's 3.14!!", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "É é H̱ İstanbul ΣΑΣ ΟΔΟΣ.", "a b c　d\x1ce\x85f",
    "́ ́x", "x" * 5000, "日本語 テキスト 한국어", "🎉🎉 👩‍👩‍👧", "'s 't 'RE a'll", "\x0b\x0c\r", "ſ K Å ﬁ", "<|startoftext|>", "don 't",
]


def test_words_give_the_ids_of_the_whole_text():
    own, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(6)
    alphabet = [c for t in ODD for c in t if len(t) < 100] + list(" \n\t'<|>aAbE.,")
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == whole(text), repr(text)


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 5)
    own = tokens.Encoder(tokens.default_tokenizer())
    for i in range(50):
        text = f"w{i} {'v' * 60}{i} the end"
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == whole(text)
    assert len(own.words) <= 9


def slow(rows):
    ids = {i: [*whole(t), 2] for i, (_, t) in enumerate(rows)}
    start, out = 0, []
    for i in sorted(ids, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        out.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("block", [tokens.BLOCK_BYTES, 50])
def test_round_trip(spark, documents, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD * 4)] + [(200, None), (None, "no id"), (300, "long text here " * 30_000)]
    docs = documents(rows).withColumn("tie", F.lit(1)).withColumn("shard", F.lit("x"))
    path = scratch_path(spark, "test-tokens")
    got = sorted((tuple(r) for r in tokens.encoded_documents(docs, path).collect()), key=lambda r: r[1])
    assert got == slow(rows)
    assert tokens.fetch(spark, path, [200, 300, 999]) == {200: [2], 300: [*whole(rows[-1][1]), 2]}


def test_ties_and_empty_table(spark, documents):
    docs = documents([(5, "one two"), (5, "three"), (5, "one two"), (4, "x")])
    got = sorted((tuple(r) for r in tokens.encoded_documents(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [4, 5, 5, 5]
    ends = [s + n for _, s, n, _ in got]
    assert [s for _, s, *_ in got] == [0, *ends[:-1]] and sorted(n for _, _, n, _ in got) == [2, 2, 3, 3]
    assert tokens.encoded_documents(docs.limit(0)).count() == 0
