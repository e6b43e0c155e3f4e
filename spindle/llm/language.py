"""Language identification with error-correcting output codes.

Every language has a codeword. Each bit of it has a binary classifier that knows nothing but the two sets of languages
with that bit on and off: naive Bayes over hashed letter n-grams, counted over all learning rows. Its margin for a text is
the mean log-odds of the text's n-grams. Decoding adds up the loss of each codeword over the bits, weighted by how well
a bit separates the languages it was learned from, and takes the least; if the next codeword is nearly as close, the
text is marked as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import staged, text_or_empty

GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
#: Counts added to every bucket.
SMOOTHING = 0.5
#: How steeply loss falls with a margin, and a score with the difference of losses.
STEEPNESS = 4.0
#: Texts with a lower score are ambiguous: the other languages together are as likely.
CLEAR = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case, 0 if it is no letter."""
    found = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            found[code] = ord(c.lower()[0])
    return found


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of letters; a gap between letters counts as one character. Empty without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]
    found = []
    for n in GRAMS:
        value = np.full(len(codes) - n + 1, n, np.uint32)
        for i in range(n):
            value = (value ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
        found.append(value >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found).astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            seen = grams(text)
            if len(seen):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(seen, minlength=BUCKETS)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: rows of a Hadamard matrix, so that any two differ in half of the places."""
    size = 1 << max(1, (2 * languages - 1).bit_length())
    rows, columns = np.arange(1, languages + 1)[:, None], np.arange(1, size)[None, :]
    odd = np.vectorize(lambda x: int(x).bit_count() & 1)(rows & columns)
    code = 1 - 2 * odd
    return code[:, np.abs(code.sum(axis=0)) < languages]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits: log-odds of an n-gram, in units of the bit's usual margin
    weight: np.ndarray  # of each bit, 1 in sum

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        seen = grams(text)
        if not len(seen) or not self.languages:
            return UNKNOWN, 0.0, True
        margin = np.bincount(seen, minlength=BUCKETS) @ self.odds / len(seen)
        loss = np.logaddexp(0, -STEEPNESS * self.code * margin) @ self.weight
        best = int(np.argmin(loss))
        score = 1 / np.exp(-STEEPNESS * (loss - loss[best])).sum()
        return self.languages[best], round(float(score), 6), bool(score < CLEAR)


def train(labelled: DataFrame) -> Model:
    """A model from rows (text, lang): all of them are counted. Null languages and texts without letters are left out.

    What the driver gathers is one count per language and bucket, whatever the number of rows.
    """
    rows = labelled.where("lang is not null").select("lang", text_or_empty().alias("text"))
    counted = staged(rows.mapInPandas(_counts, "lang string, bucket long, n long")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counted.toPandas()
    languages = sorted(counts["lang"].unique())
    if len(languages) < 2:  # nothing to tell apart: codewords without bits
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    table = np.zeros((len(languages), BUCKETS))
    table[counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    code = codewords(len(languages))
    share = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=1, keepdims=True)
    on, off = (code > 0).astype(float), (code < 0).astype(float)
    odds = np.log(share.T @ on / on.sum(axis=0)) - np.log(share.T @ off / off.sum(axis=0))
    usual = (share @ odds) * code  # the margin each language has by itself, positive if the bit is right
    scale = np.maximum(usual.mean(axis=0), 1e-9)
    weight = np.maximum(usual.min(axis=0) / scale, 1e-3)
    return Model(languages, code, odds / scale, weight / weight.sum())


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("text", "lang")


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def prediction(model: Model) -> Column:
    """Struct of lang_pred, score and ambiguous for the column ``text``."""

    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=_PREDICTED.names)

    return F.pandas_udf(predicted, _PREDICTED)(text_or_empty())


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Learns from the rows that are not held out and have an id and a language. Texts that are null or have no letter are
    ``und`` with score 0, and so is every text if there is nothing to learn from. Extra columns are ignored.
    """
    model = train(learning_rows(docs))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), prediction(model).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told, all columns kept: texts without a letter and ambiguous ones go.

    Where there is nothing to learn from, only texts without a letter go.
    """
    model = train(learning_rows(docs))
    if not model.languages:
        return docs.where(text_or_empty().rlike(r"\p{L}"))
    return docs.where(~prediction(model)["ambiguous"])
