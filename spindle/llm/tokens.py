"""Token ids in binary files: each document compressed by itself, with one dictionary shared by all.

A corpus folder holds Parquet tables, so any store that Spark reads will do:

* ``dictionary``: one row, the zstandard dictionary, its SHA-256 and the width of an id in bytes;
* ``blocks``: in the order of ids, rows of about ``BLOCK_BYTES``: the frames of consecutive documents, end to end, with
  the offset index (ids, offsets, token counts), the shard, the tokens of the shard before the block, and the
  dictionary's hash;
* ``shards``: the tokens of the corpus before each shard.

A short document is read from one block (found by its range of ids) and decompressed alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm.common import BATCH_CONF, BATCH_ROWS, text_or_empty
from spindle.session import scratch_path

END_ID = 2
#: The dictionary is trained on this many documents (those with the least hashes) of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
BLOCK_BYTES = 1 << 20
#: Words whose ids a worker remembers, and the longest of them in bytes.
WORDS, WORD_BYTES = 1_000_000, 48
BLOCKS = (
    "shard int, block int, first_id long, last_id long, dict_hash string, start long, tokens long, "
    "ids array<long>, offsets array<long>, n_tokens array<long>, payload binary"
)


_PLAIN = re.compile(rb"[a-z]+")
_MARKS = re.compile(rb"(?<=[a-z0-9])([.,!?;:]+)(?=\s|$)")
_COMBINED = re.compile("[A-Z][^\x00-\u02ff]")


class Encoder:
    """Ids of texts as bytes, equal to those the tokenizer gives for the whole text.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words one after the other;
    most words of a corpus have been seen before. So that more of them have, marks after a word become a word (the
    tokenizer splits there too) and ASCII letters are lower-cased first, as it would do; not in texts that may hold a
    special token, or a capital that a combining character follows. Words of ASCII letters go to its model directly.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}

    def _encode(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word):
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode())]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if "<|" not in text and (text.isascii() or not _COMBINED.search(text)):
            raw = _MARKS.sub(rb" \1", raw.lower())
        words = raw.split()
        if len(self.words) > WORDS:
            self.words.clear()
        known, rare = self.words, {}
        for word in set(words).difference(known):
            (known if len(word) <= WORD_BYTES else rare)[word] = self._encode(word)
        if rare:
            known = {w: known[w] if w in known else rare[w] for w in set(words)}
        return b"".join([known[w] for w in words])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from the serialised ids of a bounded sample. Too small a sample becomes the dictionary as it is."""
    short = docs.select(text_or_empty().alias("text"), "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    marked = short.select("text", F.xxhash64("doc_id", "text").alias("h"))
    least = [r["h"] for r in marked.select("h").orderBy("h").limit(sample_docs).collect()]
    few = marked.where(F.col("h") <= (least[-1] if least else 0)).limit(sample_docs)
    ids = F.udf(lambda t: bytearray(encoder(tokenizer).encode(t)), "binary")
    samples = sorted(bytes(r[0]) for r in few.select(ids("text")).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _packer(tokenizer: str, dictionary: bytes):
    digest = hashlib.sha256(dictionary).hexdigest()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, made, before = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer)
        end = np.array([END_ID], own.dtype).tobytes()
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        ids, sizes, counts, frames = [], [0], [], []

        def block() -> pd.DataFrame:
            known = [x for x in ids if x is not None]  # null ids come first
            row = (shard, made, known[0] if known else None, ids[-1], digest, before, sum(counts), list(ids), list(sizes), list(counts), b"".join(frames))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                serialised = own.encode(text) + end
                frames.append(compressor.compress(serialised))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                sizes.append(sizes[-1] + len(frames[-1]))
                counts.append(len(serialised) // own.dtype.itemsize)
                if sizes[-1] >= BLOCK_BYTES:
                    yield block()
                    made, before = made + 1, before + sum(counts)
                    ids, sizes, counts, frames = [], [0], [], []
        if ids:
            yield block()

    return pack


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the ids of all texts, each followed by the end id, in ascending order of doc_id.

    Null texts count as empty; null ids come first; rows of one id are ordered by a hash of the text. ``path`` must not
    exist. Extra columns are ignored; an empty table makes tables without blocks.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    dictionary = train_dictionary(docs, tokenizer)
    width = encoder(tokenizer).dtype.itemsize
    head = [(hashlib.sha256(dictionary).hexdigest(), width, bytearray(dictionary))]
    spark.createDataFrame(head, "dict_hash string, width int, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    try:
        ordered.mapInPandas(_packer(tokenizer, dictionary), BLOCKS).write.parquet(f"{path}/blocks")
    finally:
        spark.conf.set(BATCH_CONF, before)
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("shard", F.coalesce(earlier, F.lit(0)).alias("base")).write.parquet(f"{path}/shards")


def _head(spark: SparkSession, path: str) -> tuple[str, np.dtype, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {path} is damaged")
    return row["dict_hash"], np.dtype(f"<u{row['width']}"), data


def _decoded(block, digest: str, dtype: np.dtype, decompressor, wanted: set | None = None):
    if block["dict_hash"] != digest:
        raise ValueError("a block was written with another dictionary")
    start = block["base"] + block["start"]
    for i, doc_id in enumerate(block["ids"]):
        n = int(block["n_tokens"][i])
        if wanted is None or doc_id in wanted:
            frame = block["payload"][block["offsets"][i] : block["offsets"][i + 1]]
            yield doc_id, start, np.frombuffer(decompressor.decompress(frame, max_output_size=n * dtype.itemsize), dtype)
        start += n


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/shards"), "shard")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed ids."""
    digest, dtype, data = _head(spark, path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for _, block in batch.iterrows():
                rows = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in _decoded(block, digest, dtype, decompressor)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return _blocks(spark, path).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents: only blocks whose range of ids holds one are read, only their frames decompressed."""
    digest, dtype, data = _head(spark, path)
    decompressor, wanted, found = zstandard.ZstdDecompressor(dict_data=_dictionary(data)), set(doc_ids), {}
    for doc_id in doc_ids:
        here = _blocks(spark, path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
        for block in here.toLocalIterator():
            found |= {d: x.tolist() for d, _, x in _decoded(block, digest, dtype, decompressor, wanted)}
    return found


def encoded_documents(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the ids below ``path`` (a fresh folder unless given) and return the index read back from the files."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_ids(docs, path, tokenizer)
    return read_index(docs.sparkSession, path)
