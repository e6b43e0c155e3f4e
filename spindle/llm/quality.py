"""Quality of texts: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each whole text becomes a vector of statistics (shares of kinds of characters, lengths and repetition of words and lines).
Scaled by the labelled rows, the vector is sent through cosines of random directions, whose inner products approximate a
Gaussian kernel. Every partition sums the normal equations of its rows, the sums meet row by row of the matrix, and only
the finished matrix, of a size that is fixed, comes to the driver to be solved. Two halves of the labelled rows are solved
apart, each scores the other, and an isotonic curve over these scores turns scores into shares of good texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty

#: Random directions, the width of the kernel in units of the scaled statistics, and the ridge per labelled row.
FEATURES, WIDTH, RIDGE = 256, 6.0, 1e-3
#: Spreads from the mean at which statistics end, so that no text lies where the kernel knows nothing.
FARTHEST = 3.0
SEED = 2024
#: Raw scores are counted in steps of 1 / STEPS from -1 to 2 before the isotonic fit.
STEPS, LOW, HIGH = 1000, -1.0, 2.0
#: A text is good from this score on.
GOOD = 0.3
#: Label rows are repeated so many times, so that the rows of one id can be dealt out.
SALTS = 16

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" ", "line": b"\n", "other_space": b"\t\r\v\f",
    "stop": b".", "comma": b",;:", "mark": b"!?", "quote": b"'\"`", "bracket": b"()[]{}<>", "sign": b"#$%&*@^~", "bar": b"|/\\_=+", "dash": b"-", "wide": bytes(range(128, 256)),
}
_WORD_STATS = (
    "bytes", "entropy", "packed", "words", "word_length", "word_spread", "longest_word", "distinct_words", "top_word", "repeated_word", "distinct_pairs",
    "capital_words", "title_words", "marked_words", "bare_signs", "lines", "distinct_lines", "line_length", "top_line",
)
STATISTICS = (*_KINDS, *_WORD_STATS)
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _i, _members in enumerate(_KINDS.values()):
    _KIND_OF[list(_members)] = _i


def statistics(text: str) -> np.ndarray:
    """The statistics of a whole text, all between 0 and some 20; zeros for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(len(STATISTICS))
    histogram = np.bincount(raw, minlength=256)
    shares = np.bincount(_KIND_OF, histogram, len(_KINDS) + 1)[:-1] / len(raw)
    p = histogram[histogram > 0] / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts, line_counts = Counter(words), Counter(lines)
    rest = (
        np.log1p(len(raw)),
        -(p * np.log2(p)).sum(),
        len(zlib.compress(raw.tobytes(), 1)) / (len(raw) + 20),
        np.log1p(len(words)),
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        np.log1p(sizes.max()),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(w[-1] in "!?#$%&*@" for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in counts) / max(1, len(counts)),
        np.log1p(len(lines)),
        len(line_counts) / len(lines),
        np.log1p(len(text) / len(lines)),
        max(line_counts.values()) / len(lines),
    )
    return np.concatenate([np.sqrt(shares), rest])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written: each text is gone through once."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].astype({"doc_id": "Int64"}).assign(stats=[statistics(t) for t in batch["text"]])

    return staged(docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(measured, "doc_id long, stats array<double>"))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: 5 divides the crc32 of the id as text. A null id is not held out."""
    return F.coalesce(_remainder(doc_id) == 0, F.lit(False))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(half, stats, y, weight) of the rows to learn from. Several labels of an id make their mean, rows of an id share
    nothing: each counts. Ids and labels that are null are left out; the ids of one half are never in the other."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    means = usable.groupBy("doc_id").agg(F.avg((F.col("quality") > 0).cast("double")).alias("y"))
    return staged(_met(stats, means).select(((_remainder(F.col("doc_id")) - 1) % 2).cast("int").alias("half"), "stats", "y"))


def _met(stats: DataFrame, means: DataFrame) -> DataFrame:
    """``stats`` joined with ``means`` by doc_id. Both are shuffled: Spark takes the repeated means for as small as the file
    of labels, and would gather them all on the driver to broadcast them."""
    means = means.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = stats.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return rows.join(means.hint("merge"), ["doc_id", "salt"])


@dataclass
class Fourier:
    """Random features of scaled statistics."""

    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(0, 1 / WIDTH, (len(self.mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Rows of features, the last one constant."""
        scaled = np.clip((stats - self.mean) / self.spread, -FARTHEST, FARTHEST)  # what is farther out is like the edge
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(stats), 1))])


def _scaling(rows: DataFrame) -> Fourier:
    """Means and spreads of the labelled rows, by one aggregate."""
    columns = [f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    found = np.array([np.nan if x is None else x for x in rows.agg(*columns).first()], float).reshape(-1, 2)
    found = np.nan_to_num(found)
    return Fourier(found[:, 0], np.maximum(found[:, 1], 1e-3))


def _vector(data: Iterator) -> np.ndarray:
    return np.array([np.asarray(x) for x in data], float)


def _equations(fourier: Fourier):
    """Of each partition and half, the rows of its sum of z z' with z'y at the end, as bytes."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = fourier.features(_vector(batch["stats"])), batch["y"].to_numpy()
            for half in (0, 1):
                own = batch["half"].to_numpy() == half
                total[half] += z[own].T @ np.hstack([z[own], y[own, None]])
        for half in (0, 1):
            if total[half].any():
                yield pd.DataFrame({"half": half, "i": np.arange(FEATURES + 1), "sums": [r.tobytes() for r in total[half]]})

    return sums


def _added(batches: pd.DataFrame) -> pd.DataFrame:
    return batches.iloc[:1].assign(sums=[np.sum([np.frombuffer(x) for x in batches["sums"]], axis=0).tobytes()])


def normal_equations(rows: DataFrame, fourier: Fourier) -> np.ndarray:
    """(half, i, j) sums over all rows; the last column is z'y. The rows of the matrices are summed on the executors."""
    parts = staged(rows.mapInPandas(_equations(fourier), "half int, i int, sums binary"))
    total = np.zeros((2, FEATURES + 1, FEATURES + 2))
    for r in parts.groupBy("half", "i").applyInPandas(_added, "half int, i int, sums binary").collect():
        total[r["half"], r["i"]] = np.frombuffer(r["sums"])
    return total


def solve(equations: np.ndarray) -> np.ndarray:
    """Ridge weights; the constant is not shrunk. Without rows, the weights are zero."""
    n = equations[-1, -2]
    if not n:
        return np.zeros(FEATURES + 1)
    penalty = np.full(FEATURES + 1, RIDGE * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(equations[:, :-1] + np.diag(penalty), equations[:, -1])


def isotonic(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve closest to the shares good / count, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for x, g, n in zip(at, good, count):
        pools.append([x * n, g, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x, g, n = np.array(pools).T
    return x / n, (g + 0.5) / (n + 1)  # no pool is sure


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = np.clip(self.fourier.features(stats) @ self.weights, LOW, HIGH)
        return np.interp(raw, self.at, np.maximum.accumulate(self.share))


def train(rows: DataFrame) -> Model:
    """A model from the rows of ``labelled``. Without any, every text is as likely good as not."""
    fourier = _scaling(rows)
    halves = normal_equations(rows, fourier)
    weights = [solve(halves[1]), solve(halves[0])]  # each half is scored by the other

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, half = fourier.features(_vector(batch["stats"])), batch["half"].to_numpy()
            raw = np.clip(np.where(half == 0, z @ weights[0], z @ weights[1]), LOW, HIGH)
            yield pd.DataFrame({"step": np.round(raw * STEPS).astype(np.int64), "y": batch["y"].to_numpy()})

    steps = rows.mapInPandas(binned, "step long, y double").groupBy("step").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n"))
    found = steps.orderBy("step").toPandas()  # a row per step at most
    if not len(found):
        return Model(fourier, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    return Model(fourier, solve(halves.sum(axis=0)), *isotonic(found["step"].to_numpy() / STEPS, found["good"].to_numpy(), found["n"].to_numpy()))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from ``GOOD`` on).

    Null texts count as empty; empty texts get the score of their statistics like others. Repeated and null ids are rows
    like others (a null id has no label). Without labels every score is 0.5. Extra columns are ignored; an empty table
    gives an empty result.
    """
    stats = with_statistics(docs)
    model = train(labelled(stats, labels))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_vector(vectors))) if len(vectors) else pd.Series([], dtype=float)

    found = staged(stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round(score("stats"), 9).alias("score")), 10_000)
    return found.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
