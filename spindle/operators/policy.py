"""Model-update policies: train on window 0, then predict, score and perhaps retrain window by window.

The driver loops over window numbers only; fitting, scoring and row selection are Spark jobs on a window's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators import evaluate as ev
from spindle.operators import ml
from spindle.operators.sampling import top_up_missing_class
from spindle.session import stable

POLICIES = ("initial_only", "retrain_all", "retrain_entropy", "retrain_uncertainty", "retrain_confidence", "renew", "ensemble")
#: Stands for a model that nothing is scored by.
_UNUSED = object()


def _fit(rows: DataFrame, kind: str, needed: bool = True):
    """A model, or None if the rows lack one of the two classes. One that is not ``needed`` is not fitted."""
    if rows.select("reject").distinct().count() < 2:
        return None
    return ml.fit_classifier(rows, kind) if needed else _UNUSED


@dataclass(frozen=True)
class _Start:
    """What all policies have in common: the windows, the model of the first one and its scores on the second one."""

    windows: list
    model: object
    scored: DataFrame | None
    scores: dict | None


def _scores(scored: DataFrame) -> dict:
    return ev.evaluate(scored, []).join(ev.confidence_cases(scored, []).drop("num_io")).first().asDict()


def _start(df: DataFrame, window: str, row: str, kind: str) -> _Start:
    windows = [r[0] for r in df.select(window).distinct().orderBy(window).collect()]
    model = _fit(df.where(F.col(window) == windows[0]), kind)
    if model is None:
        raise ValueError("the first window holds one class only")
    scored = _predict([model], df.where(F.col(window) == windows[1]), row) if len(windows) > 1 else None
    return _Start(windows, model, scored, None if scored is None else _scores(scored))


def run_policies(
    df: DataFrame, policies: Sequence[str] = POLICIES, window: str = "window_id", row: str = "row_id", kind: str = "logistic", min_rows: int = 100
) -> DataFrame:
    """``run_policy`` for several policies; the first model is fitted and scored once for all of them."""
    start, out = _start(df, window, row, kind), None
    for name in policies:
        part = run_policy(df, name, window, row, kind, min_rows, start)
        out = part if out is None else out.unionByName(part)
    return out


def run_policy(
    df: DataFrame,
    policy: str,
    window: str = "window_id",
    row: str = "row_id",
    kind: str = "logistic",
    min_rows: int = 100,
    start: _Start | None = None,
) -> DataFrame:
    """One row of scores per later window. ``df`` holds window, row id, the scaled features and ``reject``.

    A retraining after the last window is reported, but its model is not fitted, as nothing is left to score.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    spark = df.sparkSession
    start = start or _start(df, window, row, kind)
    models = [start.model]
    keep = ("num_io", "accuracy", "auc", "fpr", "fnr", "entropy", "uncertainty", "percent_best_case", "percent_worst_case", "percent_lucky_case", "percent_clueless_case")
    results = []
    for i, current in enumerate(start.windows[1:], 1):
        rows = df.where(F.col(window) == current)
        scored = start.scored if i == 1 else _predict(models, rows, row)
        scores = start.scores if i == 1 else _scores(scored)
        retrained = False
        if policy != "initial_only":
            last = i == len(start.windows) - 1
            retrained = _update(models, policy, rows, scored, scores, row, kind, min_rows, last)
        results.append((policy, int(current), *[float(scores[k]) for k in keep], retrained, len(models)))
    schema = "algo string, window_id bigint, " + ", ".join(f"{k} double" for k in keep) + ", retrained boolean, models int"
    return spark.createDataFrame(results, schema)


def _predict(models: list, rows: DataFrame, row: str) -> DataFrame:
    if len(models) == 1:
        return stable(ml.score(models[0], rows, [row]))
    parts = [ml.score(m, rows, [row]).withColumn("model", F.lit(str(i))) for i, m in enumerate(models)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return stable(ev.ensemble(every, [row]))


def _update(models: list, policy: str, rows: DataFrame, scored: DataFrame, scores: dict, row: str, kind: str, min_rows: int, last: bool) -> bool:
    if policy == "renew":
        if scores["accuracy"] >= 0.8:
            return False
        chosen = scored
    elif policy == "ensemble":
        if scores["accuracy"] < 0.8:
            chosen = scored
        elif scores["percent_best_case"] < 70:
            chosen = ev.retrain_rows(scored, [], "confidence", min_rows=1)
        else:
            return False
    else:
        rule = policy.removeprefix("retrain_")
        chosen = ev.retrain_rows(scored, [], rule, min_rows=min_rows)
    training = rows.join(chosen.select(row), row, "left_semi")
    training = top_up_missing_class(training, rows, [], [row])
    fresh = _fit(training, kind, needed=not last)
    if fresh is None:
        return False
    if policy == "ensemble":
        models.append(fresh)
    else:
        models[:] = [fresh]
    return True
