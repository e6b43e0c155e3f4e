"""How two tokenizers cut the same texts: links between their tokens, counted through inverted pair bitmaps.

A link is an occurrence of a token of tokenizer A and one of B that share bytes. Every pair of ids has an inverted list of
documents, kept as compressed bitmaps: documents are numbered in ranges of ``RANGE``, and for a pair and a range there is
one presence bitmap, followed by multiplicity planes that hold, bit by bit, how often more than once a document has the
pair. Tasks write bitmaps of the few documents at hand; these are merged by OR, and their set bits counted: the presence
bitmaps give a pair's documents, all planes weighted by their place its links. Pairs get their scores, the scores go back
along the postings to the documents.

Both tokenizers work word by word: neither joins a space, or a line break, to what stands before it. So a text is cut
there, and what a worker has seen before is looked up: the ids, the groups and the links of a word. Texts in which one of
the tokenizers doesn't give back the bytes have no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema
from tokenizers import Tokenizer

from spindle.llm.common import staged

#: Documents to a range, so that a document's place in it takes two bytes.
RANGE = 1 << 15
#: Entries (a pair in a document) that a task gathers before it writes their bitmaps.
ENTRIES = 1 << 22
#: Words that a worker remembers, and their characters.
WORDS, WORD_CHARS = 300_000, 6_000_000
#: Words from this length on go to an encoder whose time grows evenly with the length.
LONG = 200
#: Characters of texts that are gone through together.
SLICE_CHARS = 2_000_000
#: Rows of bitmaps to a batch.
FLUSHED = 10_000
_ROW_BITS = 33
#: Scores of up to so many pairs are broadcast (some 30 MB); more are joined by a shuffle, in so many salts.
BROADCAST_PAIRS, SALTS = 1_000_000, 8
#: A space or line break begins a word if there is none before and after it.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The same where there is no other white space.
_PLAIN = re.compile(r"[ \n]\S+")


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), sizes


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of all i, sizes[i] each."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def byte_level(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE file as bytes with their ids, whose order must be that of the merges."""
    with open(path) as file:
        stored = json.load(file)
    special = {t["content"] for t in stored["added_tokens"]}
    vocabulary, letters = stored["model"]["vocab"], _byte_letters()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in stored["model"]["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if stored["normalizer"] or not plain.items() <= (stored["pre_tokenizer"] or {}).items() or merged != sorted(merged):
        raise ValueError(f"{path} is no byte-level BPE with merges in the order of ids")
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Aligner:
    """Tokens of single words under both tokenizers, and what follows from them. Words are numbered as they are learned;
    number 0 is a word that a tokenizer doesn't give back."""

    def __init__(self, path_a: str, path_b: str):
        ranks = byte_level(path_a)
        self.a = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = Tokenizer.from_file(path_a)
        self.long.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        tokens = {i: t for t, i in ranks.items()}
        self.bytes_a = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece goes on after the end of a word: words can't be cut there")
        self.lengths_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(t) for t in self.bytes_b], np.int64)
        highest = max(len(self.bytes_a), len(self.bytes_b))
        #: Ids as text, with each mark that may follow.
        self.spelled = {mark: np.array([f"{i}{mark}" for i in range(highest)], object) for mark in ",|;\n"}
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.numbers: dict[str, int] = {}
        self.pair_numbers: dict[int, int] = {}
        self.groups: list[str] = [""]
        self.sizes = np.zeros((1, 4), np.int64)  # tokens of A and B, groups, links
        self.starts = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)  # numbers of the pairs of each word, end to end
        self.pairs = np.zeros(0, np.int64)  # the pair of each number, as a * 2**32 + b
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        """Number new words; each starts with a space or line break."""
        found_a = [self.a.encode_ordinary(w) if len(w) < LONG else self.long.encode(w, add_special_tokens=False).ids for w in words]
        # the model puts a space before what it gets; before a line break that is a piece of its own
        found_b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        found_b = [ids if w[0] == " " else ids[1:] for w, ids in zip(words, found_b)]
        raw = [w.encode() for w in words]
        same = [r == b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) for r, a, b in zip(raw, found_a, found_b)]
        self.numbers.update((w, 0) for w, s in zip(words, same) if not s)
        words, raw, found_a, found_b = ([x for x, s in zip(xs, same) if s] for xs in (words, raw, found_a, found_b))
        if not words:
            return
        first_number = len(self.groups)
        self.numbers.update(zip(words, range(first_number, first_number + len(words))))
        self.chars += sum(map(len, words))
        # all words are gone through as one text, as both sides have a token end at the end of each
        (a, sizes_a), (b, sizes_b) = _flat(found_a), _flat(found_b)
        lengths_a = self.lengths_a[a]
        ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(self.lengths_b[b])
        first = np.searchsorted(ends_b, ends_a - lengths_a, side="right")
        met = np.searchsorted(ends_b, ends_a, side="left") - first + 1  # tokens of B that a token of A meets
        pairs = (np.repeat(a, met) << 32) | b[_ragged(first, met)]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        word_ends = np.cumsum([len(r) for r in raw])
        n_groups = np.diff(np.searchsorted(common, word_ends, side="right"), prepend=0)
        links_upto = np.cumsum(met)[np.cumsum(sizes_a) - 1]
        n_links = np.diff(links_upto, prepend=0)
        self.groups += self._spell(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), np.cumsum(n_groups) - 1)
        self.starts = np.concatenate([self.starts, len(self.links) + links_upto - n_links])
        self.sizes = np.concatenate([self.sizes, np.stack([sizes_a, sizes_b, n_groups, n_links], axis=1)])
        distinct, which = np.unique(pairs, return_inverse=True)
        known = self.pair_numbers
        numbers = np.array([known.setdefault(p, len(known)) for p in distinct.tolist()], np.int64)
        self.pairs = np.concatenate([self.pairs, distinct[numbers >= len(self.pairs)]])
        self.links = np.concatenate([self.links, numbers[which]])

    def _spell(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_groups: np.ndarray) -> list[str]:
        """The groups of each word as text; ``last_groups`` are the last ones of the words."""
        group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        ends = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        texts = self.spelled[","][ids]
        for mark, here in (("|", ends & (side == 0)), (";", ends & (side == 1)), ("\n", ends & (side == 1) & np.isin(group, last_groups))):
            texts[here] = self.spelled[mark][ids[here]]
        return "".join(texts.tolist()).split("\n")[:-1]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, end to end, and how many each text has: none if it has no tokens."""
        cut = [split(t) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        fresh = distinct.difference(self.numbers)
        if self.numbers and (len(self.numbers) + len(fresh) > self.most or self.chars > WORD_CHARS):
            self.clear()
            fresh = distinct
        if fresh:
            self.learn(list(fresh))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        if not numbers.all():
            owner = np.repeat(np.arange(len(cut)), sizes)
            lost = np.isin(np.arange(len(cut)), owner[numbers == 0])
            numbers, sizes = numbers[~lost[owner]], np.where(lost, 0, sizes)
        return numbers, sizes

    #: Words to remember.
    most = WORDS


def split(text: str) -> list[str]:
    """The words of a space and the text, each with what comes before it. A cut never leaves a lone space at the end."""
    text = " " + text
    words = _PLAIN.findall(text)
    return words if sum(map(len, words)) == len(text) else _CUT.split(text)


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def compress(places: np.ndarray) -> bytes:
    """A bitmap of sorted places in a range: the places in two bytes each, or one bit for every place if that is shorter."""
    if 2 * len(places) < RANGE // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(RANGE, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def expand(bitmap: bytes) -> np.ndarray:
    """The places of a bitmap."""
    if len(bitmap) < RANGE // 8:
        return np.frombuffer(bitmap, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def merge(parts: list[list[bytes]]) -> list[bytes]:
    """OR of bitmaps with their planes, of different documents each."""
    return [compress(np.unique(np.concatenate([expand(p[k]) for p in parts if k < len(p)]))) for k in range(max(map(len, parts)))]


def _popcount(bitmap: Column) -> Column:
    size = F.octet_length(bitmap)
    return F.when(size < RANGE // 8, F.floor(size / 2)).otherwise(F.bitmap_count(bitmap)).cast("long")


def _documents(planes: Column) -> Column:
    return _popcount(planes[0])


def _links(planes: Column) -> Column:
    """Links behind a pair's bitmaps: presence counts once, plane k for 2**(k-1) more."""
    weighted = F.transform(planes, lambda p, k: F.call_function("shiftleft", _popcount(p), F.greatest(k - 1, F.lit(0))))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x)


def bitmaps(pairs: np.ndarray, places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Pairs and their bitmaps from entries of a range, by ascending place: a pair stands ``times`` times in the document there."""
    order = np.argsort(pairs, kind="stable")
    pairs, places, more = pairs[order], places[order], times[order] - 1
    heads = _heads(pairs)
    bounds = np.append(heads, len(pairs)).tolist()
    planes = [[compress(places[a:b])] for a, b in zip(bounds, bounds[1:])]
    which = np.repeat(np.arange(len(heads)), np.diff(bounds))
    for k in range(int(more.max()).bit_length()):
        lit = np.flatnonzero(more >> k & 1)
        owner, there = which[lit], places[lit]
        bounds = np.append(_heads(owner), len(lit)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            own = planes[owner[a]]
            own += [b""] * (k + 1 - len(own)) + [compress(there[a:b])]
    return pairs[heads], planes


def _heads(keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys starts."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


#: Rows of documents (pair is null) and of a pair's bitmaps in a range (place is null).
_PARTS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("range", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary()))]
)


def _filled(columns: dict) -> pa.RecordBatch:
    """A batch of these columns, the others null."""
    size = len(columns["range"])
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _PARTS], schema=_PARTS)


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about ``SLICE_CHARS``."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _encoder(path_a: str, path_b: str, entries: int, words: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        own.most = words
        row = TaskContext.get().partitionId() << _ROW_BITS  # ranges belong to one task; a repeated task numbers alike
        held: list[tuple[np.ndarray, ...]] = []

        def flushed(number: int) -> Iterator[pa.RecordBatch]:
            if held:
                pairs, planes = bitmaps(*[np.concatenate(x) for x in zip(*held)])
                for i in range(0, len(pairs), FLUSHED):
                    part = pairs[i : i + FLUSHED]
                    yield _filled({"pair": part, "planes": planes[i : i + FLUSHED], "range": np.full(len(part), number)})
            held.clear()

        for batch in batches:
            texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"]
            for piece in _slices(texts):
                numbers, sizes = own.words(texts[piece])
                rows = row + np.arange(len(sizes))
                row += len(sizes)
                ends = np.cumsum(sizes)
                totals = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(own.sizes[numbers], axis=0)])
                spelled = list(map(own.groups.__getitem__, numbers.tolist()))
                digests = [hashlib.sha256(";".join(spelled[e - n : e]).encode()).hexdigest() if n else "" for n, e in zip(sizes.tolist(), ends.tolist())]
                counts = dict(zip(_PARTS.names[1:5], (totals[ends] - totals[ends - sizes]).T))
                yield _filled({"doc_id": doc_ids[piece], **counts, "groups_sha256": digests, "range": rows // RANGE, "place": rows % RANGE})
                # each word of a text once, then each pair of it once
                owner = np.repeat(np.arange(len(sizes)), sizes)
                used, times = np.unique(owner << 32 | numbers, return_counts=True)
                n_links = own.sizes[used & 0xFFFFFFFF, 3]
                links = own.links[_ragged(own.starts[used & 0xFFFFFFFF], n_links)]
                keys = np.repeat(used >> 32, n_links) << 32 | links
                order = np.argsort(keys, kind="stable")
                heads = _heads(keys[order])
                keys, times = keys[order][heads], np.add.reduceat(np.repeat(times, n_links)[order], heads) if len(heads) else heads
                at = rows[keys >> 32]
                for number in np.unique(at // RANGE).tolist():
                    if held and number != since:
                        yield from flushed(since)
                    since, here = number, at // RANGE == number
                    held.append((own.pairs[keys[here] & 0xFFFFFFFF], (at[here] % RANGE).astype(np.uint16), times[here].astype(np.int32)))
                    if sum(len(x[0]) for x in held) >= entries:
                        yield from flushed(number)
        if held:
            yield from flushed(since)

    return encode


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _merged(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: None if p is None else merge([list(x) for x in p]))


def _weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of pairs summed up for every document of the ranges that a task gets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, rows in batch.groupby("range"):
            total = sums.setdefault(number, np.zeros((2, RANGE), np.int64))
            lists, dense = [], []
            for links, best, planes in zip(rows["links"].tolist(), rows["best"].tolist(), rows["planes"]):
                for k, plane in enumerate(planes):
                    times = 1 << max(k - 1, 0)
                    (lists if len(plane) < RANGE // 8 else dense).append((plane, links * times, best * times))
            if lists:
                places = np.frombuffer(b"".join([p for p, _, _ in lists]), "<u2")
                sizes = [len(p) // 2 for p, _, _ in lists]
                np.add.at(total[0], places, np.repeat(np.array([x for _, x, _ in lists], np.int64), sizes))
                np.add.at(total[1], places, np.repeat(np.array([x for _, _, x in lists], np.int64), sizes))
            for plane, links, best in dense:
                places = expand(plane)
                total[0][places] += links
                total[1][places] += best
    for number, total in sums.items():
        used = np.flatnonzero(total[0])
        yield pd.DataFrame({"range": number, "place": used.astype(np.int32), "count_sum": total[0][used], "n_best": total[1][used]})


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row per document with its range and place. ``postings``: (range, pair, planes), pair being
    a * 2**32 + b. ``scores``: (pair, a, b, documents, links, best) of every pair, best where no pair of b has more links."""

    documents: DataFrame
    postings: DataFrame
    scores: DataFrame

    def scored_documents(self) -> DataFrame:
        """The documents with the scores of their pairs' postings: n_best and count_sum."""
        scores = self.scores.select("pair", "links", F.col("best").cast("int").alias("best"))
        if self.scores.count() <= BROADCAST_PAIRS:
            found = self.postings.join(F.broadcast(scores), "pair")
        else:  # a pair that stands everywhere has postings in every range: they are dealt out by the range
            salted = scores.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
            found = self.postings.withColumn("salt", F.pmod("range", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
        rows = found.select("range", "links", "best", "planes").repartition("range")
        sums = rows.mapInPandas(_weights, "range long, place int, count_sum long, n_best long")
        out = self.documents.join(sums, ["range", "place"], "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, entries: int = ENTRIES, words: int = WORDS) -> Alignment:
    """Encode every text with both tokenizers (a byte-level one and one of pieces) and count the links of their tokens.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
    digest. Null and repeated ids are rows like others. Extra columns are ignored; an empty table gives empty tables.
    """
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    parts = staged(docs.select("doc_id", "text").mapInArrow(_encoder(path_a, path_b, entries, words), from_arrow_schema(_PARTS)))
    documents = parts.where("pair IS NULL").drop("pair", "planes")
    # ranges are dealt out whole, so that the bitmaps of one need no further shuffle to meet
    rows = parts.where("pair IS NOT NULL").select("range", "pair", "planes").repartition("range")
    several = rows.groupBy("range", "pair").agg(F.collect_list("planes").alias("parts"))
    planes = F.coalesce(_merged(F.when(F.size("parts") > 1, F.col("parts"))), F.col("parts")[0])
    postings = staged(several.select("range", "pair", planes.alias("planes")), 10_000)
    counts = postings.groupBy("pair").agg(F.sum(_documents(F.col("planes"))).alias("documents"), F.sum(_links(F.col("planes"))).alias("links"))
    counts = staged(counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "documents", "links"))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    scores = staged(counts.join(most, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("most")).alias("best")))
    return Alignment(documents, postings, scores)


def aligned_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. See ``align``."""
    found = align(docs).scored_documents()
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
