"""Update policies share what they have in common; the training table makes its features once."""

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindle.operators import ml, policy
from spindle.plans import learning
from tests.conftest import SF

SOME = ("initial_only", "retrain_all")


def _rows(spark):
    rng, rows = random.Random(4), []
    for i in range(240):
        x = [rng.gauss(0, 1), rng.gauss(0, 1)]
        rows.append((i // 80, i, x, int(x[0] + rng.gauss(0, 1) > 0.5 * (i // 80))))
    return spark.createDataFrame(rows, "window_id long, row_id long, x array<double>, reject int").withColumn("scaled", array_to_vector("x"))


def test_policies_share_the_first_model(spark, monkeypatch):
    df, fitted, fit = _rows(spark), [], ml.fit_classifier
    alone = [r for name in SOME for r in policy.run_policy(df, name, min_rows=10).collect()]
    monkeypatch.setattr(ml, "fit_classifier", lambda rows, kind: fitted.append(kind) or fit(rows, kind))
    together = policy.run_policies(df, SOME, min_rows=10).collect()
    assert together == alone and len(together) == 2 * len(SOME)
    assert len(fitted) == 2  # the first one, and one after the middle window
    assert any(r["retrained"] and r["window_id"] == 2 for r in together)


def test_features_are_made_once(spark, monkeypatch):
    written, write = [], learning.stable
    monkeypatch.setattr(learning, "stable", lambda df: written.append(df.columns) or write(df))
    rows = learning.training(spark, SF)
    assert len(written) == 2 and "prev_latency_1" in written[0] and rows.where(F.col("window_id").isNull()).count() == 0
