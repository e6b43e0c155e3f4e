"""Substring duplicates: sentences of passages that occur before, in the same document or in another one.

Every run of ``RUN`` consecutive sentences, or of as many as it takes to have ``MIN_WORDS`` words or ``MIN_CHARS`` characters,
is hashed to 128 bits and joined over all documents. The first place of a run, by document and position, stays; at every
other place all its sentences go. Sentences end at their marks and at line breaks. One of more than ``MOST_WORDS`` words is
cut before words whose own hash says so (one in ``CUT``), so that a passage falls into the same pieces wherever it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty

RUN = 3
#: A run has so many words, or characters where words are not told apart by spaces.
MIN_WORDS, MIN_CHARS = 10, 60
#: Sentences up to so many words stay whole; of longer ones no piece has more than ``LARGEST`` words.
MOST_WORDS, CUT, LARGEST = 20, 12, 40
#: A hash with so many places is met by a broadcast, and of these there are so many at most.
HOT, MOST_HOT = 10_000, 50_000
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_WORD = re.compile(r"\S+")

Piece = tuple[int, int, int, str]


def starts_piece(word: str) -> bool:
    """Whether a long sentence is cut before this word: a matter of the word alone."""
    return xxhash.xxh3_64_intdigest(word) % CUT == 0


def sentences(text: str) -> list[Piece]:
    """(start, end, words, normalised text) of each sentence; long ones in pieces."""
    found = []
    for m in _SENTENCE.finditer(text):
        words = m[0].lower().split()
        if len(words) <= MOST_WORDS:
            if words:
                found.append((m.start(), m.end(), len(words), " ".join(words)))
            continue
        places = [w.span() for w in _WORD.finditer(text, m.start(), m.end())]
        begin = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or i - begin == LARGEST or starts_piece(words[i]):
                found.append((places[begin][0], places[i - 1][1], i - begin, " ".join(words[begin:i])))
                begin = i
    return found


def runs(pieces: list[Piece], length: int = RUN) -> list[tuple[bytes, int, int]]:
    """(hash, start, end) of the shortest runs from each sentence on that have enough sentences, and words or characters."""
    found, end, words, chars = [], 0, 0, 0
    for begin in range(len(pieces)):
        while end < len(pieces) and (end < begin + length or (words < MIN_WORDS and chars < MIN_CHARS)):
            words += pieces[end][2]
            chars += len(pieces[end][3])
            end += 1
        if end < begin + length or (words < MIN_WORDS and chars < MIN_CHARS):
            break
        text = " ".join([p[3] for p in pieces[begin:end]])
        found.append((xxhash.xxh3_128_digest(text.encode()), pieces[begin][0], pieces[end - 1][1]))
        words -= pieces[begin][2]
        chars -= len(pieces[begin][3])
    return found


_PLACES = "h1 long, h2 long, doc_id long, m1 long, m2 long, start int, end int"


def _all_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [runs(sentences(t)) for t in batch["text"]]
        sizes = [len(x) for x in found]
        halves = np.frombuffer(b"".join(r[0] for x in found for r in x), "<i8").reshape(-1, 2)
        yield pd.DataFrame(
            {
                "h1": halves[:, 0],
                "h2": halves[:, 1],
                "doc_id": batch["doc_id"].repeat(sizes).to_numpy(),
                "m1": batch["m1"].repeat(sizes).to_numpy(),
                "m2": batch["m2"].repeat(sizes).to_numpy(),
                "start": np.array([r[1] for x in found for r in x], np.int32),
                "end": np.array([r[2] for x in found for r in x], np.int32),
            }
        )


def _marked(docs: DataFrame) -> DataFrame:
    """Documents with a mark of 128 bits that tells apart rows of one id."""
    body = docs.select("doc_id", text_or_empty().alias("text"))
    return body.withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64(F.lit("second"), "text")})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, m1, m2, spans): for each document the spans of its runs that occur before, sorted by start.

    ``m1`` and ``m2`` are hashes of the text. Rows equal in id and text count as one document; of rows that share an id
    only, the one with the lesser hashes is first. Null ids come last.
    """
    found = staged(_marked(docs).mapInPandas(_all_runs, _PLACES))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "m1", "m2", "start")
    often = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    often = staged(often.where("n > 1"))
    # no more than MOST_HOT hashes can have so many places; those meet a broadcast, their places are not shuffled
    hot = often.where(F.col("n") > max(HOT, found.count() // MOST_HOT)).drop("n")
    rest = found
    if several := not hot.isEmpty():
        hot = F.broadcast(staged(hot))
        rest = found.join(hot, ["h1", "h2"], "left_anti")
    later = rest.join(often.drop("n"), ["h1", "h2"]).where(place != F.col("first"))
    if several:
        later = later.union(found.join(hot, ["h1", "h2"]).where(place != F.col("first")))
    return later.groupBy("doc_id", "m1", "m2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"]):
            pieces, kept, removed, done, at, reached = sentences(text), [], 0, 0, 0, -1
            spans = [] if spans is None else spans
            for start, end, _, _ in pieces:
                while at < len(spans) and spans[at]["start"] <= start:
                    reached = max(reached, spans[at]["end"])
                    at += 1
                if end <= reached:
                    kept.append(text[done:start])
                    removed, done = removed + 1, end
            kept.append(text[done:])
            rows.append((len(pieces), removed, "".join(kept)))
        made = pd.DataFrame(rows, columns=["n_sentences", "n_removed", "text"])
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), made], axis=1)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed and ``text`` without the sentences that repeat.

    What stands between removed sentences stays, so lines keep their breaks. Null texts count as empty. Rows with a null id
    are told apart by their texts and come after all others. Extra columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs).withColumnsRenamed({"doc_id": "id", "m1": "of1", "m2": "of2"})
    marked = _marked(docs)
    same = marked["doc_id"].eqNullSafe(spans["id"]) & (marked["m1"] == spans["of1"]) & (marked["m2"] == spans["of2"])
    joined = marked.join(spans, same, "left")
    return joined.select("doc_id", "text", "spans").mapInPandas(_without, "doc_id long, n_sentences long, n_removed long, text string")
