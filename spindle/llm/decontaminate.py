"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with k = m * ``error_rate`` edits. Cut into k + 1 pieces, at least one piece of it is
then free of edits, so it is found by an exact search for all pieces of all items at once (Aho-Corasick). Each hit says
where the item would lie; that window is verified with Myers' bit-parallel edit distance.

Items and documents are compared as lower-case words (letters and digits) with single spaces between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import text_or_empty

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Items with fewer words are no passage: they occur by chance.
MIN_WORDS = 5
#: Items are searched in blocks of about so many characters: this bounds what a task holds, whatever the benchmark.
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")

Hit = tuple[int, int, int, int]


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def _places(text: str) -> list[int]:
    """For each character of the normalised text, its place in ``text``."""
    at: list[int] = []
    gap = False
    for i, c in enumerate(text):
        for x in c.lower():
            if not x.isalnum():
                gap = True
                continue
            if gap and at:
                at.append(i)
            at.append(i)
            gap = False
    return at


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces of nearly equal length."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


class Pattern:
    """Myers' bit-parallel search for one text, with any place in the other as its start."""

    def __init__(self, text: str):
        self.length, self.masks = len(text), {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least distance to a substring, and the first end of one that has it."""
        full, high = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        least, end = score, 0
        for j, c in enumerate(text, 1):
            same = self.masks.get(c, 0)
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            raised, lowered = down | full & ~(horizontal | up), up & horizontal
            if raised & high:
                score += 1
            elif lowered & high:
                score -= 1
            raised, lowered = raised << 1 & full, lowered << 1 & full
            up, down = lowered | full & ~(vertical | raised), raised & vertical
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    """All items of a block: finds those that occur in a text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            errors = int(len(text) * error_rate)
            self.items[item] = (text, errors, Pattern(text), Pattern(text[::-1]))
            for begin, end in pieces(len(text), errors):
                found.setdefault(text[begin:end], []).append((item, end))
        self.search = ahocorasick.Automaton()
        for piece, places in found.items():
            self.search.add_word(piece, places)
        if found:
            self.search.make_automaton()
        self.empty = not found

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the parts of a normalised text where an item can lie; overlapping ones are joined."""
        starts: dict[int, set[int]] = {}
        for at, places in self.search.iter(text):
            for item, end in places:
                starts.setdefault(item, set()).add(at + 1 - end)
        for item, found in starts.items():
            whole, errors, *_ = self.items[item]
            span = None
            for start in sorted(found):
                begin, end = max(0, start - errors), start + len(whole) + errors
                if span and begin <= span[1]:
                    span[1] = end
                    continue
                if span:
                    yield item, span[0], span[1]
                span = [begin, end]
            yield item, span[0], span[1]

    def hits(self, text: str) -> list[Hit]:
        """(item, distance, start, end) for each item that occurs: its closest and then first place, in ``text``."""
        if self.empty or not text:
            return []
        plain, best = normalise(text), {}
        for item, begin, end in self.windows(plain):
            _, errors, pattern, backwards = self.items[item]
            distance, to = pattern.best(plain[begin:end])
            if distance <= errors and (item not in best or distance < best[item][0]):
                _, back = backwards.best(plain[begin : begin + to][::-1])
                best[item] = (distance, begin + to - back, begin + to)
        if not best:
            return []
        places = _places(text)
        return [(item, distance, places[a], places[b - 1] + 1) for item, (distance, a, b) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The different normalised items as numbered lists of bounded size; ``number`` is a hash of the text."""
    plain = F.udf(lambda t: normalise(t or ""), T.StringType())
    texts = benchmark.select(plain(F.col("text")).alias("plain")).distinct()
    texts = texts.where(F.size(F.split("plain", " ")) >= MIN_WORDS)
    total = texts.agg(F.sum(F.length("plain"))).first()[0] or 0
    blocks = total // block_chars + 1
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("plain"), F.lit(blocks)) == block).select("plain").collect()
        yield [(number, r["plain"]) for number, r in enumerate(sorted(rows, key=lambda r: r["plain"]))]


def _matcher(items: list[tuple[int, str]], error_rate: float) -> Callable[[], Matcher]:
    """Builds the matcher once in each task."""
    built: list[Matcher] = []

    def get() -> Matcher:
        if not built:
            built.append(Matcher(items, error_rate))
        return built[0]

    return get


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, end) for each document and each test item that occurs in it.

    The place is the closest one in the document, the first if there are several, in code points of the text. Null and
    empty texts have no hits; nor have items of fewer than five words. Items that are equal as words are searched once
    and reported under each of their ids. Rows that repeat a document id are reported one by one. Either table may be
    empty. Extra columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, plain string, distance long, start long, end long"
    found = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, block_chars):
        if not items:
            continue
        texts, matcher = dict(items), _matcher(items, error_rate)

        def match(batches: Iterator[pd.DataFrame], texts=texts, matcher=matcher) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, texts[h[0]], *h[1:]) for d, t in zip(batch["doc_id"], batch["text"]) for h in matcher().hits(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "plain", "distance", "start", "end"])
                yield out.astype({"doc_id": batch["doc_id"].dtype})

        found = found.union(docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(match, schema))
    plain = F.udf(lambda t: normalise(t or ""), T.StringType())
    ids = benchmark.select("item_id", plain(F.col("text")).alias("plain")).distinct()
    return found.join(ids, "plain").select("doc_id", "item_id", "distance", "start", "end")


def _free(matcher: Callable[[], Matcher]):
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([not matcher().hits(t) for t in texts], dtype=bool)

    return F.pandas_udf(free, T.BooleanType())


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no test item occurs, all columns; decided in place, without moving texts."""
    for items in item_blocks(benchmark, block_chars):
        if items:
            docs = docs.where(_free(_matcher(items, error_rate))(text_or_empty()))
    return docs
