"""Queries that apply each operator to its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.alignment import aligned_documents
from spindle.llm.common import table
from spindle.llm.decontaminate import contaminated
from spindle.llm.exact import exact_duplicates
from spindle.llm.language import identify
from spindle.llm.lines import repeated_lines
from spindle.llm.merkle import proven_documents
from spindle.llm.mixing import mix
from spindle.llm.quality import scored_documents
from spindle.llm.quotes import linked_messages
from spindle.llm.secrets import scan_documents
from spindle.llm.simhash import near_duplicates
from spindle.llm.spans import without_repeats
from spindle.llm.tokens import encoded_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@_query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


#: The base patterns for DuckDB: either case is spelled out, as folding there also takes letters outside of ASCII.
_ASSIGN = """(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _spans_sql(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of one kind; the texts between the matches tell where each match starts."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e FROM (
    SELECT doc_id, m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m FROM (
      SELECT doc_id, regexp_extract_all(body, '{pattern}') AS found, string_split_regex(body, '{pattern}') AS gaps FROM bodies))
    ) WHERE {keep}"""


_VALUE_LENGTH = f"length(regexp_extract(m, '{_ASSIGN.replace(chr(39), chr(39) * 2)}({_VALUE})$', 1)) >= 8"
SECRETS_SQL = f"""WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), spans AS (
  {_spans_sql("assign", 1, _ASSIGN + _VALUE, _VALUE_LENGTH)}
  UNION ALL {_spans_sql("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_spans_sql("hex", 3, "[0-9a-f]+", "length(m) >= 32")}),
found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS listed FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(listed, '') AS spans
FROM bodies LEFT JOIN found USING (doc_id)"""


@_query("op2_secret_scans", SECRETS_SQL)
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(table(spark, folder, "documents"))


@_query(
    "op6_exact_dedup",
    r"""WITH bodies AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body)""",
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@_query("op8_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op10_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = without_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@_query("op5_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


@_query("op3_token_output")
def token_output(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_documents(table(spark, folder, "documents"))


@_query("op4_chat_quotes")
def chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return linked_messages(table(spark, folder, "conversations"))


@_query("op7_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("source")


@_query("op9_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


#: crc32 of a decimal number in SQL: the table follows from the polynomial, the digits go through it one by one.
_CRC = """crcs AS (SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
  remainders AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: xor(c // 256, crc[xor(c % 256, d) + 1]))) AS crc32 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crcs)"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: Levels of one tree per key: nodes of (key, level, pos), each run of eight hashed until a key has one node left.
_LEVELS = """SELECT key, 0 AS level, pos, h, n FROM {leaves}
  UNION ALL SELECT key, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY key, level, pos // 8"""

MERKLE_SQL = f"""WITH RECURSIVE {_CRC},
  leaves AS (SELECT doc_id, lang AS key, leaf AS h, claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN crc32 % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim
      FROM documents LEFT JOIN remainders USING (doc_id))),
  nodes AS ({_LEVELS.format(leaves="leaves", name="nodes")}),
  tops AS (SELECT key AS lang, h, row_number() OVER (ORDER BY encode(key) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
  top_leaves AS (SELECT '' AS key, pos, h, n FROM tops),
  top_nodes AS ({_LEVELS.format(leaves="top_leaves", name="top_nodes")}),
  heights AS (SELECT key, max(level) AS height FROM nodes GROUP BY key),
  steps AS (
    SELECT l.key, l.pos AS leaf, x.level, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos // CAST(pow(8, x.level) AS BIGINT)) AS before,
      string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos // CAST(pow(8, x.level) AS BIGINT)) AS after
    FROM leaves l JOIN nodes x ON x.key IS NOT DISTINCT FROM l.key AND x.n > 1 AND x.pos // 8 = l.pos // CAST(pow(8, x.level + 1) AS BIGINT) GROUP BY ALL
    UNION ALL
    SELECT l.key, l.pos, height + x.level, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < t.pos // CAST(pow(8, x.level) AS BIGINT)),
      string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > t.pos // CAST(pow(8, x.level) AS BIGINT))
    FROM leaves l JOIN heights g ON g.key IS NOT DISTINCT FROM l.key JOIN tops t ON t.lang IS NOT DISTINCT FROM l.key
      JOIN top_nodes x ON x.n > 1 AND x.pos // 8 = t.pos // CAST(pow(8, x.level + 1) AS BIGINT) GROUP BY ALL),
  ways AS (SELECT key, leaf, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level) AS proof,
    list({{'a': coalesce(before, ''), 'b': coalesce(after, '')}} ORDER BY level) AS way FROM steps GROUP BY key, leaf),
  folded AS (
    SELECT l.key, l.pos, coalesce(l.claim, l.h) AS h, w.way, 1 AS step FROM leaves l LEFT JOIN ways w ON w.key IS NOT DISTINCT FROM l.key AND w.leaf = l.pos
    UNION ALL SELECT key, pos, sha256(way[step].a || h || way[step].b), way, step + 1 FROM folded WHERE step <= len(way)),
  ends AS (SELECT key, pos, h FROM folded WHERE step > coalesce(len(way), 0))
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.key JOIN top_nodes r ON r.n = 1
  JOIN ends e ON e.key IS NOT DISTINCT FROM l.key AND e.pos = l.pos LEFT JOIN ways w ON w.key IS NOT DISTINCT FROM l.key AND w.leaf = l.pos"""


@_query("op13_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return proven_documents(table(spark, folder, "documents"))


@_query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_documents(table(spark, folder, "documents"))


@_query("op11_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
