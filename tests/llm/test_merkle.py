import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spindle.llm import merkle
from spindle.llm.queries import QUERIES
from tests.conftest import SF

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def slow_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[i : i + 8]) for i in range(0, len(at), 8)])
    return levels


def slow_way(levels, i):
    way = []
    for level in levels[:-1]:
        run = i // 8 * 8
        way.append((level[run:i], level[i + 1 : run + 8]))
        i //= 8
    return way


def slow(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees[lang] = own, slow_levels([slow_leaf(r) for r in own])
    top = slow_levels([trees[x][1][-1][0] for x in langs])
    root = top[-1][0] if langs else None
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            way = slow_way(levels, i) + slow_way(top, k)
            node = levels[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = slow_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in way for x in left + right])
            out.append((r[0], levels[0][i], levels[-1][0], root, proof, node, node == root))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def make(documents, rows, parts=5):
    df = documents([(r[0], r[4], r[2], r[1]) for r in rows], parts)
    return df


def with_chars(rows):
    return [(*r[:3], None if r[4] is None else len(r[4]), r[4]) for r in rows]


def test_addresses_are_a_permutation_split_at_half_height():
    for levels in range(1, 6):
        places = np.concatenate([merkle.addresses(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(places) == list(range(merkle.tree_size(levels)))
    # five levels: two above, then 64 subtrees of three, each in one piece
    for j in (0, 5, 63):
        below = [merkle.addresses(5, 2 + d, np.arange(j * 8**d, (j + 1) * 8**d)) for d in range(3)]
        flat = np.sort(np.concatenate(below))
        assert flat[0] == 9 + j * 73 and (np.diff(flat) == 1).all()


def test_blocks_against_plain_levels():
    rng = random.Random(1)
    for count, height in ((1, 0), (1, 4), (2, 1), (8, 1), (9, 2), (70, 3), (513, 4), (4096, 4)):
        leaves = [rng.randbytes(32) for _ in range(count)]
        levels = [[x.hex() for x in leaves]]
        for _ in range(height):
            at = levels[-1]
            levels.append([h(*at[i : i + 8]) for i in range(0, len(at), 8)])
        payload = merkle.build_block(leaves, height)
        assert payload[:32].hex() == levels[-1][0] and merkle.nodes_of(payload, count, height) == levels[0]
        ways = merkle.siblings(payload, count, height)
        for i in {0, count // 2, count - 1}:
            assert ways[i] == [("".join(a), "".join(b)) for a, b in slow_way(levels, i)]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_brute_force(documents, height):
    rng = random.Random(height)
    langs = [None, "en", "é", "Z", "a" * 40, ""]
    rows = [(i, rng.choice([None, "s", "tü"]), "en" if i % 3 else rng.choice(langs), 0, "Ab Cé" * rng.randrange(4)) for i in range(700)]
    rows += [(5, None, "en", 0, None), (None, None, None, 0, None), (None, "x", "en", 0, "Q"), (3, "s", "solo", 0, "Only")]
    rows += [(7, "dup", "en", 0, "Twice")] * 70 + [(-4, "s", "en", 0, "NEGATIVE" * 9000)]
    rows = with_chars(rows)
    docs = make(documents, rows).selectExpr("*", "1 as key", "2 as hash", "3 as pos", "4 as id", "5 as count")
    assert got(merkle.proven_documents(docs, height)) == slow(rows)  # low blocks make several tiers


def test_many_keys_make_a_tall_top(documents):
    rows = with_chars([(i, None, f"l{i % 100}", 0, "T") for i in range(130)])
    assert got(merkle.proven_documents(make(documents, rows), 1)) == slow(rows)


def test_empty_and_single(documents):
    one = with_chars([(1, None, None, 0, None)])
    assert merkle.proven_documents(make(documents, one).limit(0)).count() == 0
    assert got(merkle.proven_documents(make(documents, one))) == slow(one)


def test_manifest_is_read_back(spark, documents, tmp_path):
    rows = with_chars([(i, "s", "en" if i % 2 else "fr", 0, f"Text {i}") for i in range(50)])
    docs = make(documents, rows)
    made = merkle.document_manifest(docs, f"file://{tmp_path}/manifest")
    again = merkle.read_manifest(spark, f"file://{tmp_path}/manifest")
    assert again.root() == made.root() and got(again.proofs()) == slow(rows)
    other = merkle.document_manifest(docs.where("doc_id <> 7"))
    assert other.root() != made.root()


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op13_merkle_manifest"](spark, SF)) == slow(rows)
