"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint has 64 bits; two documents are linked if theirs differ in two bits or fewer. The fingerprint is cut into
three segments of 22, 21 and 21 bits, each padded to the 23 bits of the binary Golay code. With two wrong bits over three
segments, some segment is free of errors while the next one (in a circle) has one at most. So a key is made of a
segment as it is and of the index of a codeword near to the next segment:

* a fingerprint is filed under the codeword nearest to that segment: the code is perfect, so there is exactly one within
  three bits;
* it looks under all codewords within four bits of it: six, or one. One wrong bit moves a word from three to four bits
  at most, so that the two meet.

Pairs that meet are verified by counting bits. A key that very many fingerprints share is not paired up: fingerprints
that use it are linked through midpoints instead. Two words that differ in two bits or fewer have a word within one bit
of both, so each emits itself and its 64 neighbours, and no more than 65 fingerprints can meet at a word.

Two bits find equal and almost equal texts only. ``one_of_each`` with a similarity links documents by the Jaccard
similarity of their runs of five words: fingerprints that meet under Golay keys and differ in two bits or fewer are
candidates, MinHash keys find those further apart, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import row_digest, staged, text_or_empty
from spindle.llm.graph import components
from spindle.llm.minhash import linked_nodes, set_keys, shared_keys

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of 23 bits (fixed value).
GENERATOR = 0b101011100011
#: A key with more fingerprints than this goes the way of midpoints.
FULL_BUCKET = 200
_CHUNK = 1 << 16
JACCARD_WORDS = 5
#: Keys of a set: at a similarity of 0.8 two sets share none of them with the probability 0.0001, above with less.
JACCARD_BANDS, JACCARD_ROWS = 30, 6
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str) -> int:
    """SimHash of the XXH64 of all runs of three words, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE_WORDS + 1)
    for begin in range(0, n, _CHUNK):
        part = words[begin : begin + _CHUNK + SHINGLE_WORDS - 1]
        runs = zip(part, part[1:], part[2:]) if len(words) >= SHINGLE_WORDS else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: 11 bits, zero for codewords."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def near_patterns() -> np.ndarray:
    """For each remainder, the patterns of four bits or fewer that have it, lightest first, filled up with the first."""
    patterns = np.array([sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(23), weight)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for pattern, remainder in zip(patterns.tolist(), _remainder(patterns).tolist()):
        found[remainder].append(pattern)
    return np.array([(x * 6)[:6] if len(x) == 1 else x for x in found], np.int64)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to file under, (n, 3), and keys to look under, (n, 18) with repeats, of unsigned fingerprints."""
    patterns, filed, looked = near_patterns(), [], []
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    for i, exact in enumerate(parts):
        word = parts[(i + 1) % 3]
        codewords = (word[:, None] ^ patterns[_remainder(word)]) >> 11
        keys = (i << 34) | (exact[:, None] << 12) | codewords
        filed.append(keys[:, :1])
        looked.append(keys)
    return np.hstack(filed), np.hstack(looked)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = batch["fp"].to_numpy(np.int64)
        filed, looked = golay_keys(own.view(np.uint64))
        yield pd.DataFrame({"fp": np.repeat(own, 3), "key": filed.ravel(), "filed": True})
        yield pd.DataFrame({"fp": np.repeat(own, 18), "key": looked.ravel(), "filed": False}).drop_duplicates()


def _verified(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def linked_pairs(fingerprints: DataFrame, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values of ``fp`` that differ in two bits or fewer."""
    keys = staged(fingerprints.select("fp").where("fp is not null").distinct().mapInPandas(_keys, "fp long, key long, filed boolean"))
    filed, looked = (keys.where(F.col("filed") == x).select("fp", "key") for x in (True, False))
    full = staged(filed.groupBy("key").count().where(F.col("count") > full_bucket).select("key"))
    crowded = not full.isEmpty()
    a = looked.withColumnRenamed("fp", "a")
    b = filed.withColumnRenamed("fp", "b")
    if crowded:
        b = b.join(full, "key", "left_anti")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & _verified("a", "b")).select("a", "b")
    if crowded:
        flips = F.concat(F.array(F.lit(0).cast("long")), F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))"))
        members = staged(keys.join(full, "key", "left_semi").select("fp").distinct())
        middle = members.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("middle"))
        met = middle.withColumnRenamed("fp", "a").join(middle.withColumnRenamed("fp", "b"), "middle")
        pairs = pairs.union(met.where((F.col("a") < F.col("b")) & _verified("a", "b")).select("a", "b"))
    return pairs.distinct()


def _placed(docs: DataFrame, full_bucket: int) -> DataFrame:
    """Rows of (doc_id, fp, ...) with ``root``, a name of the component, and ``component_id``, its least doc_id."""
    distinct = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked_pairs(distinct, full_bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", full_bucket: int = FULL_BUCKET) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the least id among the documents reachable over links. Null texts count as empty; texts without
    words have fingerprint zero and are linked like any other. Rows with a null or repeated id stay, each with its
    own fingerprint; a component without any id has a null id. An empty table gives an empty result.
    """
    marked = staged(docs.select(F.col(id_column).alias("doc_id"), _fingerprints(text_or_empty(text_column)).alias("fp")))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _placed(marked, full_bucket).select("doc_id", shown, "component_id")


def shingle_set(text: str) -> np.ndarray:
    """Hashes of all runs of five words, sorted, without repeats; of fewer words, one of them all."""
    words = text.encode().lower().split()
    of_words = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(JACCARD_WORDS, len(words))
    found = np.full(max(1, len(words) - JACCARD_WORDS + 1), size, np.uint64)
    for i in range(size):
        found = (found ^ of_words[i : i + len(found)]) * _FACTOR
        found ^= found >> np.uint64(29)
    return np.unique(found)


_SET_KEYS = T.StructType(
    [T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]
)


@F.pandas_udf(_SET_KEYS)
def _set_keys(texts: pd.Series) -> pd.DataFrame:
    nodes, keys = [], []
    for text in texts:
        found = shingle_set(text)
        nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
        keys.append(set_keys(found, JACCARD_BANDS, JACCARD_ROWS))
    return pd.DataFrame({"node": nodes, "keys": keys, "fp": [fingerprint(t) for t in texts]})


@F.pandas_udf(T.BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


def _similar_sets(similarity: float):
    @F.pandas_udf(T.BooleanType())
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            found.append(common + 1e-9 >= similarity * (len(a) + len(b) - common))
        return pd.Series(found, dtype=bool)

    return similar


def close_nodes(marked: DataFrame, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """Candidates (a, b) among the nodes of (node, fp): those whose fingerprints are linked by ``linked_pairs``.

    The nodes of one fingerprint all meet its least node, and of two linked fingerprints the least nodes meet.
    """
    heads = staged(marked.groupBy("fp").agg(F.min("node").alias("head")))
    equal = marked.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    x, y = (heads.select(F.col("fp").alias(f"fp_{n}"), F.col("head").alias(n)) for n in "ab")
    pairs = linked_pairs(heads, full_bucket).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return staged(equal.union(pairs.join(x, "fp_a").join(y, "fp_b").where("a <> b").select("a", "b")).distinct())


def _placed_by_sets(docs: DataFrame, similarity: float, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """(doc_id, digest, root) of each row of ``docs``; rows with equal sets are one node."""
    digest = row_digest(docs)
    marked = staged(docs.select("doc_id", digest.alias("digest"), _set_keys(text_or_empty()).alias("of")).select("doc_id", "digest", "of.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "keys")).alias("first")
    nodes = staged(marked.groupBy("node").agg(first).select("node", "first.*"))
    shared = shared_keys(nodes.select("node", F.explode("keys").alias("key")))
    close = close_nodes(marked.select("node", "fp").distinct(), full_bucket)
    met = shared.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = nodes.join(met, "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    rows = docs.select("doc_id", digest.alias("digest"), text_or_empty().alias("text"))
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["digest"] == wanted["of"]))
    sets = staged(rows.dropDuplicates(["node"]).select("node", _sets("text").alias("set")))
    similar = _similar_sets(similarity)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}"), (F.length("set") / 8).alias(f"n_{n}")) for n in "ab")
        near = F.least("n_a", "n_b") + 1e-6 >= similarity * F.greatest("n_a", "n_b")
        return staged(pairs.join(x, "a").join(y, "b").where(near).where(similar("set_a", "set_b")).select("a", "b"))

    share = similarity / (1 + similarity)
    roots = linked_nodes(shared, verified, sets, similarity, lambda m, n: share * (m + n), first=close)
    return marked.select("doc_id", "digest", "node").join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, full_bucket: int = FULL_BUCKET, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least doc_id (null last).

    With a ``similarity``, documents are linked if the Jaccard similarity of their runs of five words is as high or higher.
    Of rows with one id and nearly one text, the row with the least hash of all its columns stays; of rows equal in all
    columns, one. All columns are kept.
    """
    digest = row_digest(docs)
    if similarity is None:
        marked = staged(docs.select("doc_id", digest.alias("digest"), _fingerprints(text_or_empty()).alias("fp")))
        placed = _placed(marked, full_bucket)
    else:
        placed = _placed_by_sets(docs, similarity, full_bucket)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("best")
    chosen = staged(placed.groupBy("root").agg(best).select("best.doc_id", "best.digest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), digest.alias("of"))
    kept = rows.join(chosen, rows["id"].eqNullSafe(chosen["doc_id"]) & (rows["of"] == chosen["digest"]), "left_semi")
    return kept.dropDuplicates(["id", "of"]).select("row.*")
