"""Scores, confidence, ensembles and update rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.stats import MOMENTS, PERCENTILES
from spindle.operators import evaluate as ev
from spindle.plans.aggregates import _moments_sql, _percentiles_sql
from spindle.plans.registry import query, rounded
from spindle.sources import fixtures
from spindle.sources.fixtures import PREDICTION, TRACE, with_views

KEYS = ["model", "window_id"]
_EPS = "2.220446049250313e-16"
_Q = f"least(greatest(probability, {_EPS}), 1::DOUBLE - {_EPS})"
_ENTROPY = f"(-{_Q} * log2({_Q}) - (1 - {_Q}) * log2(1 - {_Q}))"
_UNCERTAIN = "(1 - abs(probability - (1 - probability)))"
_SCORED = f"""scored AS (SELECT model, window_id, count(*) AS num_io, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, avg({_ENTROPY}) AS entropy, avg({_UNCERTAIN}) AS uncertainty,
    count(*) FILTER (WHERE prediction = 1) AS num_reject FROM prediction GROUP BY ALL),
rated AS (SELECT *, (tp + tn) / num_io AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(tn / nullif(tn + fp, 0), 0) AS tnr FROM scored),
evaluated AS (SELECT * EXCLUDE (tnr), coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1,
    round(fp / (fp + tn + 0.1), 3) AS fpr, round(fn / (tp + fn + 0.1), 3) AS fnr,
    CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0 ELSE round((recall + tnr) / 2, 3) END AS auc,
    round(recall * "precision" + (1 - recall) * (tp + fn) / num_io, 3) AS pr_auc FROM rated)"""
_EVAL = with_views(TRACE, PREDICTION, _SCORED)


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return ev.evaluate(fixtures.prediction(spark, folder), KEYS)


@query(
    "ev1_confusion_scores",
    _EVAL + """ SELECT model, window_id, num_io, tp, tn, fp, fn, num_reject, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM evaluated""",
)
def confusion_scores(spark: SparkSession, folder: str) -> DataFrame:
    names = ["num_io", "tp", "tn", "fp", "fn", "num_reject", "accuracy", "precision", "recall", "f1"]
    return rounded(evaluated(spark, folder).select(*KEYS, *names))


@query("ev2_error_rates", _EVAL + " SELECT model, window_id, fpr, fnr FROM evaluated")
def error_rates(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).select(*KEYS, "fpr", "fnr")


@query("ev3_roc_auc", _EVAL + " SELECT model, window_id, auc FROM evaluated")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).select(*KEYS, "auc")


@query("ev4_mean_entropy", _EVAL + " SELECT model, window_id, round(entropy, 6) AS entropy FROM evaluated")
def mean_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluated(spark, folder).select(*KEYS, "entropy"))


@query("ev5_mean_uncertainty", _EVAL + " SELECT model, window_id, round(uncertainty, 6) AS uncertainty FROM evaluated")
def mean_uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluated(spark, folder).select(*KEYS, "uncertainty"))


@query(
    "ev6_uncertainty_statistics",
    with_views(TRACE, PREDICTION)
    + f""" SELECT model, {_moments_sql("entropy", _ENTROPY, 6)}, {_percentiles_sql("entropy", _ENTROPY, 6)},
    {_moments_sql("uncertainty", _UNCERTAIN, 6)}, {_percentiles_sql("uncertainty", _UNCERTAIN, 6)} FROM prediction GROUP BY 1""",
)
def uncertainty_statistics(spark: SparkSession, folder: str) -> DataFrame:
    wide = ev.uncertainty_statistics(fixtures.prediction(spark, folder), ["model"])
    names = [f"{m}_{s}" for m in ("entropy", "uncertainty") for s in (*MOMENTS, *PERCENTILES) if s != "mode"]
    return rounded(wide.select("model", *names))


_CELL = """celled AS (SELECT *, CASE WHEN abs(probability - 0.5::DOUBLE) >= 0.1::DOUBLE THEN CASE WHEN label = prediction THEN 'best' ELSE 'worst' END
    ELSE CASE WHEN label = prediction THEN 'lucky' ELSE 'clueless' END END AS cell FROM prediction)"""
_CASES = "cases AS (SELECT model, window_id, count(*) AS num_io, " + ", ".join(
    f"count(*) FILTER (WHERE cell = '{c}') AS {c}_case, count(*) FILTER (WHERE cell = '{c}' AND label = 1) AS {c}_reject, "
    f"count(*) FILTER (WHERE cell = '{c}' AND label = 0) AS {c}_accept, count(*) FILTER (WHERE cell = '{c}') / count(*) * 100 AS percent_{c}_case"
    for c in ev.CELLS
) + " FROM celled GROUP BY ALL)"


@query(
    "ev7_confidence_cases",
    with_views(TRACE, PREDICTION, _CELL, _CASES)
    + " SELECT * REPLACE ("
    + ", ".join(f"round(percent_{c}_case, 6) AS percent_{c}_case" for c in ev.CELLS)
    + ") FROM cases",
)
def confidence_cases(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.confidence_cases(fixtures.prediction(spark, folder), KEYS))


@query(
    "ev8_near_threshold",
    with_views(TRACE, PREDICTION) + " SELECT row_id, CASE WHEN abs(probability - 0.5::DOUBLE) <= 0.05::DOUBLE + 1e-5 * 0.5::DOUBLE THEN 1 ELSE 0 END AS is_near FROM prediction",
)
def near_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.prediction(spark, folder).select("row_id", ev.near_threshold(atol=0.05).alias("is_near"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per model and window, with made-up times that grow with the rows."""
    rows = fixtures.prediction(spark, folder)
    joined = ev.evaluate(rows, KEYS).join(ev.confidence_cases(rows, KEYS).drop("num_io"), KEYS)
    n = F.col("num_io").cast("double")
    return joined.withColumns({"train_time": n * 0.001 * (F.col("window_id") % 5 + 1), "prediction_time": n * 0.0001 * (F.col("window_id") % 3 + 1)})


_RESULTS = """results AS (SELECT e.*, percent_best_case, percent_worst_case, percent_lucky_case, percent_clueless_case,
    e.num_io * 0.001::DOUBLE * (window_id % 5 + 1) AS train_time, e.num_io * 0.0001::DOUBLE * (window_id % 3 + 1) AS prediction_time
  FROM evaluated e JOIN cases USING (model, window_id))"""


@query(
    "ev9_comparison_columns",
    with_views(TRACE, PREDICTION, _SCORED, _CELL, _CASES, _RESULTS)
    + """ SELECT model, window_id, round(percent_lucky_case + percent_clueless_case, 4) AS percent_not_confident_case,
    round(100 - percent_lucky_case - percent_clueless_case, 4) AS percent_confident_case, round(100 * accuracy, 4) AS accuracy, round(100 * auc, 4) AS auc,
    round(100 * entropy, 4) AS entropy, round(100 * uncertainty, 4) AS uncertainty, round(100 * train_time / max(train_time) OVER (), 4) AS train_overhead,
    round(100 - 100 * train_time / max(train_time) OVER (), 4) AS train_computation_efficiency, round(1e6 * prediction_time / num_io, 4) AS inference_time FROM results""",
)
def comparison_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = [
        "percent_not_confident_case", "percent_confident_case", "accuracy", "auc", "entropy", "uncertainty", "train_overhead",
        "train_computation_efficiency", "inference_time",
    ]
    return rounded(ev.comparison_columns(results(spark, folder)).select(*KEYS, *names), 4)


@query(
    "ev10_not_best_share",
    with_views(TRACE, PREDICTION, _CELL, _CASES)
    + " SELECT model, window_id, round(percent_worst_case + percent_clueless_case + percent_lucky_case, 4) AS combination_case FROM cases",
)
def not_best_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.comparison_columns(results(spark, folder)).select(*KEYS, "combination_case"), 4)


@query(
    "ev11_writes_accepted",
    with_views(TRACE, PREDICTION)
    + """ SELECT row_id, CASE WHEN io_type = 0 THEN 0 ELSE label END AS label, CASE WHEN io_type = 0 THEN 0 ELSE prediction END AS prediction,
    CASE WHEN io_type = 0 THEN 1 ELSE probability END AS probability FROM prediction""",
)
def writes_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return ev.writes_accepted(fixtures.prediction(spark, folder)).select("row_id", "label", "prediction", "probability")


_EXPERTS = """experts AS (SELECT m.model, window_id, row_id, label, ((row_id * m.k) % 1000) / 1000.0::DOUBLE AS probability
  FROM prediction, (VALUES ('a', 37), ('b', 91), ('c', 57)) m(model, k))"""


def experts(spark: SparkSession, folder: str) -> DataFrame:
    """Every row scored by three models."""
    rows = fixtures.prediction(spark, folder).select("window_id", "row_id", "label")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("_k")) for m, k in (("a", 37), ("b", 91), ("c", 57))])
    scored = rows.select("*", F.inline(models))
    return scored.withColumn("probability", ((F.col("row_id") * F.col("_k")) % 1000) / F.lit(1000.0)).drop("_k")


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of a model: its mean probability."""
    return experts(spark, folder).groupBy("model").agg(F.round(F.avg("probability"), 6).alias("weight"))


_WEIGHTS = "weights AS (SELECT model, round(avg(probability), 6) AS weight FROM experts GROUP BY 1)"


@query(
    "ev12_ensemble",
    with_views(TRACE, PREDICTION, _EXPERTS, _WEIGHTS)
    + """, p AS (SELECT row_id, max(label) AS label, count(*) AS models, sum(weight * probability) / sum(weight) AS probability FROM experts JOIN weights USING (model) GROUP BY 1)
  SELECT row_id, label, models, round(probability, 6) AS probability, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM p""",
)
def ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.ensemble(experts(spark, folder), ["row_id"], _weights(spark, folder)))


@query(
    "ev13_group_sum",
    with_views(TRACE, PREDICTION, _EXPERTS, _WEIGHTS)
    + """, p AS (SELECT row_id, max(label) AS label, count(*) AS models, sum(weight * probability) AS probability FROM experts JOIN weights USING (model) GROUP BY 1)
  SELECT row_id, label, models, round(probability, 9) AS probability, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM p""",
)
def group_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.ensemble(experts(spark, folder), ["row_id"], _weights(spark, folder), total=True), 9)


_AUCS = """aucs AS (SELECT window_id, model, CASE WHEN count(*) FILTER (WHERE label = 1) = 0 OR count(*) FILTER (WHERE label = 0) = 0 THEN 0 ELSE
    round((coalesce(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1), 0) + coalesce(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0), 0)) / 2, 3) END AS auc
  FROM (SELECT *, (probability > 0.5) = (label = 1) AS hit FROM experts) GROUP BY ALL),
alive AS (SELECT aucs.* FROM aucs JOIN (VALUES ('a', 0), ('b', 4), ('c', 9)) b(model, born) USING (model) WHERE born <= window_id),
best AS (SELECT window_id, model AS best_model, auc AS best_auc FROM alive QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY auc DESC, model) = 1)"""


def best_models_of(spark: SparkSession, folder: str) -> DataFrame:
    rows = experts(spark, folder).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    scores = ev.evaluate(rows, ["window_id", "model"]).select("window_id", "model", "auc")
    # a model is born in the first window that holds a row it is sure of
    born = spark.createDataFrame([("a", 0), ("b", 4), ("c", 9)], "model string, born bigint")
    return ev.best_models(ev.models_up_to(scores, born))


@query(
    "ev14_best_models",
    with_views(TRACE, PREDICTION, _EXPERTS, _AUCS) + " SELECT window_id, best_model, best_auc, lag(best_model) OVER (ORDER BY window_id) AS used_model FROM best",
)
def best_models(spark: SparkSession, folder: str) -> DataFrame:
    return best_models_of(spark, folder)


@query("ev14_reuse_counts", with_views(TRACE, PREDICTION, _EXPERTS, _AUCS) + " SELECT best_model AS model, count(*) AS count FROM best GROUP BY 1")
def reuse_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ev.reuse_counts(best_models_of(spark, folder))


@query(
    "ev15_accuracy_weights",
    with_views(TRACE, PREDICTION, _EXPERTS)
    + """, m AS (SELECT window_id, model, avg(pow(1 - CASE WHEN label = 1 THEN probability ELSE 1 - probability END, 2)) AS msei FROM experts GROUP BY ALL),
  b AS (SELECT window_id, avg(label) AS p FROM experts GROUP BY 1),
  w AS (SELECT window_id, model, msei, p * pow(1 - p, 2) + (1 - p) * pow(p, 2) AS mser, 1 / (msei + 1e-10) AS weight FROM m JOIN b USING (window_id)),
  d AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(weight, 9), model) = 1 AS is_dropped FROM w)
  SELECT window_id, model, round(msei, 6) AS msei, round(mser, 6) AS mser, round(weight, 6) AS weight, is_dropped,
    NOT is_dropped AND model <> 'c' AND weight > 1 / mser AS is_refit FROM d""",
)
def accuracy_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.accuracy_weights(experts(spark, folder), ["window_id"], limit=2))


@query(
    "ev16_borda_ranks",
    with_views(TRACE, PREDICTION)
    + """, s AS (SELECT model, window_id, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (WHERE probability < 0.25) AS overlap FROM prediction GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY accuracy DESC, model) AS concept_rank, row_number() OVER (PARTITION BY window_id ORDER BY overlap DESC, model) AS covariate_rank FROM s)
  SELECT model, window_id, round(accuracy, 6) AS accuracy, overlap, concept_rank, covariate_rank, concept_rank + covariate_rank AS borda,
    row_number() OVER (PARTITION BY window_id ORDER BY concept_rank + covariate_rank, model) = 1 AS is_best FROM r""",
)
def borda_ranks(spark: SparkSession, folder: str) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    scores = fixtures.prediction(spark, folder).groupBy(*KEYS).agg(F.avg(hit).alias("accuracy"), F.count_if(F.col("probability") < 0.25).alias("overlap"))
    return rounded(ev.borda_ranks(scores, ["window_id"]))


@query(
    "ev18_retrain_rows",
    with_views(TRACE, PREDICTION, _CELL)
    + f""", r AS (SELECT 'entropy' AS rule, window_id, row_id, 100 AS least FROM celled WHERE {_ENTROPY} > 0.85
    UNION ALL SELECT 'uncertainty', window_id, row_id, 40 FROM celled WHERE {_UNCERTAIN} > 0.85
    UNION ALL SELECT 'confidence', window_id, row_id, 100 FROM celled WHERE cell <> 'best' UNION ALL SELECT 'all', window_id, row_id, 300 FROM celled)
  SELECT rule, window_id, row_id FROM r QUALIFY count(*) OVER (PARTITION BY rule, window_id) >= least""",
)
def retrain_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.prediction(spark, folder)
    parts = []
    for rule, least in (("entropy", None), ("uncertainty", 40), ("confidence", None), ("all", 300)):
        parts.append(ev.retrain_rows(rows, ["window_id"], rule, min_rows=least).select(F.lit(rule).alias("rule"), "window_id", "row_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("ev19_renewals", _EVAL + " SELECT model, window_id, round(accuracy, 6) AS accuracy, accuracy < 0.5 AS renew FROM evaluated")
def renewals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.needs_renewal(evaluated(spark, folder), 0.5).select(*KEYS, "accuracy", "renew"))


_ADMIT = """admitted AS (SELECT model, window_id, accuracy, best_case / c.num_io AS best_ratio, c.num_io, best_case,
    CASE WHEN accuracy < 0.5 THEN 'new_group' WHEN best_case / c.num_io < 0.45 THEN 'new_member' ELSE 'none' END AS admit
  FROM evaluated e JOIN cases c USING (model, window_id))"""


@query(
    "ev22_admission_share",
    with_views(TRACE, PREDICTION, _SCORED, _CELL, _CASES, _ADMIT) + " SELECT model, window_id, round(best_ratio, 6) AS best_ratio, best_ratio < 0.45 AS admits FROM admitted",
)
def admission_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.prediction(spark, folder)
    ruled = ev.admission(ev.evaluate(rows, KEYS), ev.confidence_cases(rows, KEYS), KEYS, 0.0, 0.45)
    return rounded(ruled.select(*KEYS, "best_ratio", (F.col("admit") == "new_member").alias("admits")))


@query("ev23_pr_auc", _EVAL + " SELECT model, window_id, pr_auc FROM evaluated")
def pr_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).select(*KEYS, "pr_auc")


@query(
    "ev24_class_report",
    with_views(TRACE, PREDICTION)
    + """, c AS (SELECT model, class, count(*) FILTER (WHERE label = prediction AND prediction = class) AS tp, count(*) FILTER (WHERE label <> prediction AND prediction = class) AS fp,
    count(*) FILTER (WHERE label = prediction AND prediction <> class) AS tn, count(*) FILTER (WHERE label <> prediction AND prediction <> class) AS fn,
    count(*) FILTER (WHERE label = class) AS support FROM prediction, (VALUES (0), (1)) v(class) GROUP BY ALL)
  SELECT *, round(coalesce(fp / nullif(fp + tn, 0), 0) * 100, 2) AS percent_fp, round(coalesce(fn / nullif(fn + tp, 0), 0) * 100, 2) AS percent_fn FROM c""",
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return ev.class_report(fixtures.prediction(spark, folder), ["model"])


@query(
    "ev25_admission_rule",
    with_views(TRACE, PREDICTION, _SCORED, _CELL, _CASES, _ADMIT)
    + """ SELECT model, window_id, round(accuracy, 6) AS accuracy, round(best_ratio, 6) AS best_ratio, admit,
    CASE admit WHEN 'new_group' THEN num_io WHEN 'new_member' THEN num_io - best_case ELSE 0 END AS train_rows FROM admitted""",
)
def admission_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixtures.prediction(spark, folder)
    return rounded(ev.admission(ev.evaluate(rows, KEYS), ev.confidence_cases(rows, KEYS), KEYS, 0.5, 0.45))


@query(
    "ag24_mean_by_algorithm",
    _EVAL + " SELECT model AS algo, round(avg(accuracy), 6) AS accuracy FROM evaluated GROUP BY 1 ORDER BY 2 DESC, 1",
)
def mean_by_algorithm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.rank_by_mean(evaluated(spark, folder).withColumnRenamed("model", "algo"), "accuracy"))


@query(
    "so4_most_uncertain",
    with_views(TRACE, PREDICTION)
    + f""" SELECT * FROM (SELECT window_id, row_id, round(e, 6) AS entropy, row_number() OVER (PARTITION BY window_id ORDER BY e DESC, row_id) AS rank
    FROM (SELECT *, round_even({_ENTROPY} * 1e9, 0) / 1e9 AS e FROM prediction)) WHERE rank <= 5""",
)
def most_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.most_uncertain(fixtures.prediction(spark, folder), ["window_id"], ["row_id"]).select("window_id", "row_id", "entropy", "rank"))
