"""Secret scans with an incremental ledger of blobs.

Every version of every file is content-addressed by the SHA-256 of its text. The ledger, a Parquet table, holds a row for
each blob and rule version that was scanned, findings or not. A scan reads only blobs whose pair with a current rule
version is not in the ledger yet, appends its rows, and joins findings back to all versions that hold the blob.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty
from spindle.session import scratch_path

#: Base patterns (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Patterns that the scan adds to the base.
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")

Span = tuple[int, int]


def _assigned(text: str) -> list[Span]:
    return [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]


def _random(text: str) -> list[Span]:
    """Runs of base64 characters with 4.5 bits a character or more."""
    found = []
    for m in BASE64.finditer(text):
        n = m.end() - m.start()
        if sum(c / n * math.log2(n / c) for c in Counter(m[0]).values()) >= 4.5:
            found.append(m.span())
    return found


def _all(pattern: re.Pattern) -> Callable[[str], list[Span]]:
    return lambda text: [m.span() for m in pattern.finditer(text)]


#: Rule kinds in the order in which spans with one start are listed: version and finder.
RULES: dict[str, tuple[int, Callable[[str], list[Span]]]] = {
    "assign": (1, _assigned),
    "access": (1, _all(ACCESS)),
    "hex": (1, _all(HEX)),
    "pem": (1, _all(PEM)),
    "jwt": (1, _all(JWT)),
    "random": (1, _random),
}
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "blob string, rule string, spans array<struct<start: long, end: long>>"


def _versions(rules: dict) -> list[str]:
    return [f"{kind}@{version}" for kind, (version, _) in rules.items()]


def _scanner(rules: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch["blob"], batch["body"], batch["todo"]):
                for rule in todo:
                    spans = rules[rule.rpartition("@")[0]][1](text)
                    rows.append((blob, rule, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["blob", "rule", "spans"])

    return scan


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, ledger_path: str, rules: dict | None = None, text_column: str = "text") -> DataFrame:
    """All rows of ``versions`` without the text, with ``blob`` and ``findings``: an array of (kind, start, end).

    A blob is scanned once, from the text of one of the rows that hold it; blobs and rule versions that the ledger has
    are not scanned again. Two runs that scan one blob at a time append equal rows, which are read once. Null texts are
    empty blobs. Spans count code points. Extra columns stay; the text column, ``blob`` and ``findings`` are replaced.
    """
    rules = RULES if rules is None else rules
    spark, wanted = versions.sparkSession, _versions(rules)
    names = [c for c in versions.columns if c not in (text_column, "blob", "findings")]
    addressed = staged(
        versions.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(text_or_empty(text_column), 256).alias("blob"))
    )
    ledger = read_ledger(spark, ledger_path)
    have = ledger.where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("have"))
    todo = addressed.select("blob").distinct().join(have, "blob", "left")
    todo = todo.select("blob", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("have", F.array().cast("array<string>"))).alias("todo"))
    todo = todo.where(F.size("todo") > 0)
    texts = versions.select(text_or_empty(text_column).alias("body")).withColumn("blob", F.sha2("body", 256))
    once = texts.groupBy("blob").agg(F.first("body").alias("body"))  # each partition sends a blob once
    staged(once.join(todo, "blob").mapInPandas(_scanner(rules), LEDGER)).write.mode("append").parquet(ledger_path)
    found = read_ledger(spark, ledger_path).where(F.col("rule").isin(wanted)).dropDuplicates(["blob", "rule"])
    kind = F.regexp_extract("rule", "^(.*)@", 1)
    order = F.array_position(F.array(*map(F.lit, rules)), kind)
    each = found.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"), kind.alias("kind"), order.alias("rank"))
    listed = each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("s.start", "rank", "kind", "s.end"))).alias("all"))
    listed = listed.select("blob", F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return addressed.join(listed, "blob", "left").select(*([F.col("row")[c].alias(c) for c in names]), "blob", F.coalesce("findings", none).alias("findings"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Counts and spans of each document: see ``queries.op2_secrets``."""
    ledger_path = ledger_path or scratch_path(docs.sparkSession, "ledger")
    found = scan_versions(docs.select("doc_id", "text"), ledger_path)

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.expr(f"filter(findings, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
