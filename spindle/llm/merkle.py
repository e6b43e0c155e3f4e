"""Merkle manifest of a dataset, stored in van Emde Boas blocks.

Every row is a leaf. The leaves of a key (a language) in order make a tree in which every ``ARITY`` consecutive nodes of a
level become their hash; the keys' roots in order make the last tree in the same way. Trees are cut into aligned blocks of
at most ``ARITY ** HEIGHT`` nodes. A block is one row that holds its subtree as an array of digests in van Emde Boas
order: the upper half of the levels first, then each lower subtree, both recursively in the same order. ``addresses`` says
where a node lies, for building as for reading. The roots of a tier of blocks are the nodes of the next tier, until every
key has one node left.

Proofs go the other way: a block gets the way from its root to the top, reads the siblings of each of its nodes from its
own array, and hands the lengthened way to the blocks below. No tree is ever in one place: a task sees single blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import staged, write_batched
from spindle.operators.ordered import fits
from spindle.session import scratch_path

ARITY = 8
#: Levels of hashing in a block: 4096 leaves, 150 kB of digests.
HEIGHT = 4
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks handed to a Python worker at once, each below a MB.
BLOCKS_AT_ONCE = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def tree_size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def addresses(levels: int, depth: int, nodes: np.ndarray) -> np.ndarray:
    """Places of the nodes (numbered from the left) at a depth below the root, in van Emde Boas order."""
    if levels == 1:
        return np.zeros(len(nodes), np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, nodes)
    below = levels - top
    width = ARITY ** (depth - top)
    return tree_size(top) + nodes // width * tree_size(below) + addresses(below, depth - top, nodes % width)


@cache
def _places(levels: int, depth: int) -> np.ndarray:
    return addresses(levels, depth, np.arange(ARITY**depth))


def digest(hexes: list[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The digests of a block over these leaves, hashed ``height`` times; absent nodes are zero."""
    levels, count = height + 1, len(leaves)
    store = np.zeros((tree_size(levels), DIGEST), np.uint8)
    store[_places(levels, height)[:count]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(count, DIGEST)
    for depth in range(height - 1, -1, -1):
        below, count = count, -(-count // ARITY)
        children = store[_places(levels, depth + 1)[:below]].tobytes().hex().encode()
        run = ARITY * 2 * DIGEST
        made = [hashlib.sha256(children[i * run : (i + 1) * run]).digest() for i in range(count)]
        store[_places(levels, depth)[:count]] = np.frombuffer(b"".join(made), np.uint8).reshape(count, DIGEST)
    return store.tobytes()


def siblings(payload: bytes, count: int, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, the hex digests to its left and right in its run, level by level up to the block's root."""
    levels = height + 1
    store = np.frombuffer(payload, np.uint8).reshape(-1, DIGEST)
    ways: list[list[tuple[str, str]]] = [[] for _ in range(count)]
    step = 1
    for depth in range(height, 0, -1):
        nodes = -(-count // step)
        row = store[_places(levels, depth)[:nodes]].tobytes().hex()
        size = 2 * DIGEST
        around = []
        for i in range(nodes):
            first, last = i // ARITY * ARITY * size, min(nodes, (i // ARITY + 1) * ARITY) * size
            around.append((row[first : i * size], row[(i + 1) * size : last]))
        for leaf in range(count):
            ways[leaf].append(around[leaf // step])
        step *= ARITY
    return ways


def fold(node: str, way: list[tuple[str, str]]) -> str:
    """The root that follows from a node and the siblings on its way."""
    for left, right in way:
        node = hashlib.sha256((left + node + right).encode()).hexdigest()
    return node


def _prefixed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hex digest of a row: each value as its length in bytes, a colon and itself, or ``-`` if null."""
    return F.sha2(F.concat(*[_prefixed(c) for c in fields.values()]), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check lower-cases: 3 divides the crc32 of the id as text. A null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its key from 0 on, and ``count``, the rows of the key. ``rows`` must be staged.

    Ties fall to the row's place in the stage, so that rows that are all alike spread over the partitions too.
    """
    by = [key, *order, "__row"]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = staged(ranged.drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__at", _PART_BITS))
    pieces = ranged.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(key)
    earlier = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift")
    # a row per key and partition that it lies in: no more than keys plus partitions
    shift = staged(pieces.select(F.col(key).alias("__key"), F.col("__part").alias("__of"), shift, F.sum("__n").over(whole).alias("count")))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of"))
    joined = ranged.join(F.broadcast(shift) if fits(shift) else shift, same)
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "count")


_BLOCK = "key string, blk long, count long, n int, height int, payload binary, ids array<long>, names array<string>, claims array<binary>"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heights = batch["height"].astype(int)
        payloads = [build_block(list(hashes), height) for hashes, height in zip(batch["hashes"], heights)]
        out = batch[["key", "blk", "count"]].assign(n=batch["hashes"].map(len), height=heights, payload=payloads)
        yield out.assign(ids=[pd.array(x, "Int64") for x in batch["ids"]], names=batch["names"], claims=batch["claims"])


def write_tiers(nodes: DataFrame, path: str, height: int = HEIGHT) -> list[DataFrame]:
    """Write the blocks of each tier below ``path`` and return them, lowest first.

    ``nodes``: key, pos (from 0 in every key), count (of the key), hash, and what leaves carry: id, name and claim (a digest
    to hold against the leaf, or null). A key whose nodes fit one block ends there: that block's root is the key's.
    """
    spark, tiers, size = nodes.sparkSession, [], ARITY**height
    while True:
        needed = reduce(lambda a, h: a + (F.col("count") > ARITY**h).cast("int"), range(height), F.lit(0))
        packed = F.sort_array(F.collect_list(F.struct("pos", "hash", "id", "name", "claim"))).alias("nodes")
        grouped = nodes.groupBy("key", "count", F.floor(F.col("pos") / size).alias("blk")).agg(packed)
        columns = {"hashes": "nodes.hash", "ids": "nodes.id", "names": "nodes.name", "claims": "nodes.claim"}
        grouped = grouped.select("key", "blk", "count", needed.alias("height"), *[F.col(c).alias(n) for n, c in columns.items()])
        place = f"{path}/{len(tiers)}"
        write_batched(grouped.mapInPandas(_pack, _BLOCK), place, BLOCKS_AT_ONCE)
        blocks = spark.read.schema(_BLOCK).parquet(place)
        tiers.append(blocks)
        wide = blocks.where(F.col("count") > size)
        if wide.isEmpty():
            return tiers
        root = F.expr(f"substring(payload, 1, {DIGEST})")
        none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("claim")]
        nodes = wide.select("key", F.col("blk").alias("pos"), F.ceil(F.col("count") / size).alias("count"), root.alias("hash"), *none)


_WAY = "way array<struct<left: string, right: string>>"


_NODE = f"key string, pos long, name string, hash string, top string, {_WAY}"


def _descend(size: int):
    """Nodes of blocks (of ``size`` at most) with their ways to the top: that of the block's root, after that within the block."""

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples(index=False):
                above = [(x["left"], x["right"]) for x in block.way]
                ways = [own + above for own in siblings(block.payload, block.n, block.height)]
                hashes = nodes_of(block.payload, block.n, block.height)
                pos = block.blk * size + np.arange(block.n)
                out = pd.DataFrame({"key": block.key, "pos": pos, "name": list(block.names), "hash": hashes, "top": block.top})
                yield out.assign(way=[[{"left": a, "right": b} for a, b in way] for way in ways])

    return descend


def nodes_of(payload: bytes, count: int, height: int) -> list[str]:
    """Hex digests of a block's leaves."""
    store = np.frombuffer(payload, np.uint8).reshape(-1, DIGEST)
    leaves = store[_places(height + 1, height)[:count]].tobytes().hex()
    return [leaves[i : i + 2 * DIGEST] for i in range(0, len(leaves), 2 * DIGEST)]


def _with_ways(tiers: list[DataFrame], ends: DataFrame, size: int) -> DataFrame:
    """Blocks of the lowest tier with ``way`` and ``top``. ``ends``: the way above each key's root, and a ``top`` to carry along."""
    upper = None
    for tier in reversed(tiers):
        last = tier.where(F.col("count") <= size)
        ready = last.join(ends.select(F.col("key").alias("k"), "way", "top"), F.col("key").eqNullSafe(F.col("k"))).drop("k")
        if upper is not None:
            inner = tier.where(F.col("count") > size)
            found = upper.select(F.col("key").alias("k"), "pos", "way", "top")
            ready = ready.unionByName(inner.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("blk") == F.col("pos"))).drop("k", "pos"))
        if tier is tiers[0]:
            return ready
        upper = staged(ready.mapInPandas(_descend(size), _NODE), BLOCKS_AT_ONCE)


@dataclass(frozen=True)
class Manifest:
    """Blocks below ``path``: of the rows' trees (``rows``, a tree per key) and of the tree over the keys (``keys``)."""

    path: str
    rows: list[DataFrame]
    keys: list[DataFrame]
    size: int

    def subroots(self) -> DataFrame:
        """(key, hash) of every key."""
        return _subroots(self.rows, self.size)

    def root(self) -> str | None:
        """The root over all keys; null for an empty table."""
        found = self.keys[-1].selectExpr(f"lower(hex(substring(payload, 1, {DIGEST}))) AS root").first()
        return found["root"] if found else None

    def proofs(self) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, root, proof_sha256 (of the siblings up to the root), folded_root (from the
        claim, or else the leaf) and verified."""
        top = F.expr(f"lower(hex(substring(payload, 1, {DIGEST})))")
        ends = self.keys[-1].select("key", top.alias("top"), F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("way"))
        above = _with_ways(self.keys, ends, self.size).mapInPandas(_descend(self.size), _NODE)
        # the root of the key itself is not on the way from its leaves: it goes along with the root of all
        ends = staged(above.select(F.col("name").alias("key"), "way", F.concat("hash", F.lit(" "), "top").alias("top")), BLOCKS_AT_ONCE)
        return staged(_with_ways(self.rows, ends, self.size).mapInPandas(_prove, _PROOF), BLOCKS_AT_ONCE)


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block in batch.itertuples(index=False):
            subroot, root = block.top.split(" ")
            above = [(x["left"], x["right"]) for x in block.way]
            rest = "".join(left + right for left, right in above)
            ways = siblings(block.payload, block.n, block.height)
            leaves = nodes_of(block.payload, block.n, block.height)
            proofs = [digest([left + right for left, right in way] + [rest]) for way in ways]
            claims = [leaf if c is None else bytes(c).hex() for leaf, c in zip(leaves, block.claims)]
            folded = [fold(claim, way + above) for claim, way in zip(claims, ways)]
            out = pd.DataFrame({"doc_id": pd.array(block.ids, "Int64"), "leaf": leaves, "subroot": subroot, "root": root, "proof_sha256": proofs})
            yield out.assign(folded_root=folded, verified=[f == root for f in folded])


def _subroots(tiers: list[DataFrame], size: int) -> DataFrame:
    ends = [t.where(F.col("count") <= size).selectExpr("key", f"substring(payload, 1, {DIGEST}) AS hash") for t in tiers]
    return reduce(DataFrame.unionByName, ends)


def write_manifest(leaves: DataFrame, path: str, height: int = HEIGHT) -> Manifest:
    """Write the manifest of ``leaves``: key, id, hash (binary digest) and claim (another digest to check, or null).

    Leaves of a key are ordered by id (null first), then by digest; equal ones are interchangeable. ``path`` must not exist.
    """
    nodes = _numbered(staged(leaves), "key", ["id", "hash"]).withColumn("name", F.lit(None).cast("string"))
    rows = write_tiers(nodes, f"{path}/rows", height)
    order = _subroots(rows, ARITY**height).select(F.lit("").alias("key"), F.col("key").alias("name"), "hash")
    order = _numbered(staged(order), "key", ["name"])
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim")]
    keys = write_tiers(order.select("*", *none), f"{path}/keys", height)
    return Manifest(path, rows, keys, ARITY**height)


def read_manifest(spark: SparkSession, path: str, height: int = HEIGHT) -> Manifest:
    """The manifest that was written below ``path`` with blocks of this height."""
    found, size = [], ARITY**height
    for part in ("rows", "keys"):
        tiers = [spark.read.schema(_BLOCK).parquet(f"{path}/{part}/0")]
        while not tiers[-1].where(F.col("count") > size).isEmpty():
            tiers.append(spark.read.schema(_BLOCK).parquet(f"{path}/{part}/{len(tiers)}"))
        found.append(tiers)
    return Manifest(path, *found, size)


def document_manifest(docs: DataFrame, path: str | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of a documents table, a tree per ``lang``; the claims are the leaves after tampering.

    Null values are written as ``-``; a null lang is a key of its own and comes first; null ids come first in their tree;
    rows that are alike in all fields are leaves of their own. Extra columns are ignored.
    """
    fields = {c: F.col(c) for c in FIELDS}
    lowered = fields | {"text": F.translate("text", UPPER, LOWER)}
    claim = F.when(tampered(F.col("doc_id")), F.unhex(leaf_hash(lowered)))
    leaves = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), F.unhex(leaf_hash(fields)).alias("hash"), claim.alias("claim"))
    return write_manifest(leaves, path or scratch_path(docs.sparkSession, "manifest"), height)


def proven_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs`` with its leaf, its roots, its proof and whether the (tampered) row still folds to the root.

    An empty table gives an empty result. Decisions on nulls, ties and repeated rows: see ``document_manifest``.
    """
    return document_manifest(docs, height=height).proofs()
