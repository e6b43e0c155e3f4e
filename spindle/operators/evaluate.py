"""Scores of accept/reject predictions, and the rules that decide on model updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.scalars import ratio, round_half_even
from spindle.functions.stats import statistics
from spindle.operators.ordered import Groups, key_join, ordered

# fixed values: machine epsilon used as clipping bound, smoothing of the error rates, confidence margin
EPSILON = 2.220446049250313e-16
RATE_SMOOTHING = 0.1
CONFIDENCE_MARGIN = 0.1
CELLS = ("best", "worst", "lucky", "clueless")


def entropy(p: Column) -> Column:
    """Binary entropy in bits, probabilities clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -q * F.log2(q) - (1 - q) * F.log2(1 - q)


def uncertainty(p: Column) -> Column:
    return 1 - F.abs(p - (1 - p))


def writes_accepted(df: DataFrame) -> DataFrame:
    """Writes are never judged: label 0, prediction 0, probability 1."""
    write = F.col("io_type") == 0
    return df.withColumns(
        {
            "label": F.when(write, 0).otherwise(F.col("label")),
            "prediction": F.when(write, 0).otherwise(F.col("prediction")),
            "probability": F.when(write, 1.0).otherwise(F.col("probability")),
        }
    )


def _confusion() -> list[Column]:
    hit, yes = F.col("label") == F.col("prediction"), F.col("prediction") == 1
    return [
        F.count(F.lit(1)).alias("num_io"),
        F.count_if(hit & yes).alias("tp"),
        F.count_if(hit & ~yes).alias("tn"),
        F.count_if(~hit & yes).alias("fp"),
        F.count_if(~hit & ~yes).alias("fn"),
        F.avg(entropy(F.col("probability"))).alias("entropy"),
        F.avg(uncertainty(F.col("probability"))).alias("uncertainty"),
        F.count_if(yes).alias("num_reject"),
    ]


def evaluate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, error rates, AUCs of the hard predictions, mean entropy and uncertainty."""
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "num_io"))
    scores = df.groupBy(*keys).agg(*_confusion()).withColumns(
        {"accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
    )
    p, r = F.col("precision"), F.col("recall")
    one_class = ((tp + fn) == 0) | ((tn + fp) == 0)
    return scores.withColumns(
        {
            "f1": ratio(2 * p * r, p + r),
            "fpr": F.round(fp / (fp + tn + RATE_SMOOTHING), 3),
            "fnr": F.round(fn / (tp + fn + RATE_SMOOTHING), 3),
            "auc": F.when(one_class, 0.0).otherwise(F.round((r + ratio(tn, tn + fp)) / 2, 3)),
            "pr_auc": F.round(r * p + (1 - r) * ratio(tp + fn, n), 3),
        }
    )


def class_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits and misses seen from each class, and the percentages of false positives and negatives."""
    seen = df.select(*keys, "label", "prediction", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    hit, here, said = F.col("label") == F.col("prediction"), F.col("label") == F.col("class"), F.col("prediction") == F.col("class")
    counts = seen.groupBy(*keys, "class").agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("tn"),
        F.count_if(~hit & ~said).alias("fn"),
        F.count_if(here).alias("support"),
    )
    return counts.withColumns(
        {
            "percent_fp": F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")) * 100, 2),
            "percent_fn": F.round(ratio(F.col("fn"), F.col("fn") + F.col("tp")) * 100, 2),
        }
    )


def uncertainty_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All statistics of the rows' entropy and uncertainty."""
    metrics = {"entropy": entropy(F.col("probability")), "uncertainty": uncertainty(F.col("probability"))}
    return statistics(df, keys, metrics)


def confidence_cell(threshold: float = 0.5, margin: float = CONFIDENCE_MARGIN) -> Column:
    """best, worst, lucky, clueless: right or wrong, with the probability away from the threshold or near it."""
    sure = F.abs(F.col("probability") - threshold) >= margin
    right = F.col("label") == F.col("prediction")
    return F.when(sure & right, "best").when(sure, "worst").when(right, "lucky").otherwise("clueless")


def confidence_cases(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, margin: float = CONFIDENCE_MARGIN) -> DataFrame:
    """Rows per confidence cell with their percentages, and the same split by the row's label (1 = reject)."""
    rows = df.withColumn("_cell", confidence_cell(threshold, margin))
    counts = [F.count(F.lit(1)).alias("num_io")]
    for cell in CELLS:
        inside = F.col("_cell") == cell
        counts.append(F.count_if(inside).alias(f"{cell}_case"))
        counts += [F.count_if(inside & (F.col("label") == v)).alias(f"{cell}_{name}") for v, name in ((1, "reject"), (0, "accept"))]
    wide = rows.groupBy(*keys).agg(*counts)
    return wide.withColumns({f"percent_{cell}_case": ratio(F.col(f"{cell}_case"), F.col("num_io")) * 100 for cell in CELLS})


def near_threshold(threshold: float = 0.5, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return (F.abs(F.col("probability") - threshold) <= atol + rtol * abs(threshold)).cast("int")


def most_uncertain(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` rows of highest entropy per group."""
    rows = df.withColumn("entropy", round_half_even(entropy(F.col("probability")), 9)).withColumn("_desc", -F.col("entropy"))
    ranked = ordered(rows, keys, ["_desc", *ids]).numbered("rank").frame()
    return ranked.where(F.col("rank") <= n).drop("_desc")


def comparison_columns(results: DataFrame) -> DataFrame:
    """Percentages, training overhead against the slowest, and inference time per I/O in us."""
    slowest = F.broadcast(results.agg(F.max("train_time").alias("_slowest")))  # one row
    rows = results.join(slowest)
    unsure = F.col("percent_lucky_case") + F.col("percent_clueless_case")
    overhead = 100 * F.try_divide(F.col("train_time"), F.col("_slowest"))
    return rows.withColumns(
        {
            "percent_not_confident_case": unsure,
            "percent_confident_case": 100 - unsure,
            "combination_case": unsure + F.col("percent_worst_case"),
            "accuracy": 100 * F.col("accuracy"),
            "auc": 100 * F.col("auc"),
            "entropy": 100 * F.col("entropy"),
            "uncertainty": 100 * F.col("uncertainty"),
            "train_overhead": overhead,
            "train_computation_efficiency": 100 - overhead,
            "inference_time": 1e6 * F.try_divide(F.col("prediction_time"), F.col("num_io").cast("double")),
        }
    ).drop("_slowest")


def ensemble(df: DataFrame, keys: Sequence[str], weights: DataFrame | None = None, threshold: float = 0.5, total: bool = False) -> DataFrame:
    """One prediction per row from several models: weighted mean of their probabilities, or their weighted sum if ``total``."""
    rows = df.withColumn("weight", F.lit(1.0)) if weights is None else df.join(weights, "model")
    p = F.sum(F.col("weight") * F.col("probability"))
    mixed = p if total else p / F.sum("weight")
    out = rows.groupBy(*keys).agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("models"), mixed.alias("probability"))
    return out.withColumn("prediction", (F.col("probability") > threshold).cast("int"))


def best_models(scores: DataFrame) -> DataFrame:
    """Per window the model of highest AUC (the first name on a tie), and the model used there: the window before's best."""
    best = scores.groupBy("window_id").agg(F.min(F.struct((-F.col("auc")).alias("a"), F.col("model").alias("m"))).alias("_b"))
    best = best.select("window_id", F.col("_b.m").alias("best_model"), (-F.col("_b.a")).alias("best_auc"))
    return ordered(best, [], ["window_id"]).shifted({"used_model": lambda w: F.lag("best_model").over(w)}, before=1).frame()


def models_up_to(scores: DataFrame, born: DataFrame) -> DataFrame:
    """Scores of the models that exist in a window: trained in it or before."""
    return scores.join(born, "model").where(F.col("born") <= F.col("window_id")).drop("born")


def reuse_counts(best: DataFrame) -> DataFrame:
    return best.groupBy(F.col("best_model").alias("model")).agg(F.count(F.lit(1)).alias("count"))


def accuracy_weights(df: DataFrame, keys: Sequence[str], limit: int, epsilon: float = 1e-10) -> DataFrame:
    """Weight of each model on a window's rows, whether it is dropped as the worst beyond ``limit``, and whether it is refitted.

    The weight is 1 over the mean squared miss of the true class; a kept model whose weight exceeds that of guessing
    by class share is refitted, except the newest (the last by name).
    """
    p_true = F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    share = F.avg(F.col("label").cast("double"))
    models = df.groupBy(*keys, "model").agg(F.avg(F.pow(1 - p_true, F.lit(2))).alias("msei"))
    base = df.groupBy(*keys).agg(share.alias("_p"), F.count_distinct("model").alias("_models"), F.max("model").alias("_newest"))
    p = F.col("_p")
    base = base.withColumn("mser", p * F.pow(1 - p, F.lit(2)) + (1 - p) * F.pow(p, F.lit(2)))
    joined = key_join(models.withColumn("weight", 1 / (F.col("msei") + epsilon)), base, keys)
    joined = joined.withColumn("_w", round_half_even(F.col("weight"), 9))
    worst = joined.groupBy(*keys).agg(F.min(F.struct(F.col("_w"), F.col("model"))).alias("_b")).select(*keys, F.col("_b.model").alias("_worst"))
    joined = key_join(joined, worst, keys)
    dropped = (F.col("_models") > limit) & (F.col("model") == F.col("_worst"))
    refit = ~dropped & (F.col("model") != F.col("_newest")) & (F.col("weight") > 1 / F.col("mser"))
    return joined.withColumns({"is_dropped": dropped, "is_refit": refit}).select(*keys, "model", "msei", "mser", "weight", "is_dropped", "is_refit")


def borda_ranks(df: DataFrame, keys: Sequence[str], concept: str = "accuracy", covariate: str = "overlap") -> DataFrame:
    """Rank of each model by accuracy plus rank by leaf overlap; the lowest sum wins, the first model on a tie."""
    rows = df.withColumns({"_a": -F.col(concept), "_c": -F.col(covariate)})
    groups = Groups.measure(df, keys)
    rows = ordered(rows, keys, ["_a", "model"], groups).numbered("concept_rank").frame()
    rows = ordered(rows, keys, ["_c", "model"], groups).numbered("covariate_rank").frame()
    rows = rows.withColumn("borda", F.col("concept_rank") + F.col("covariate_rank")).drop("_a", "_c")
    best = rows.groupBy(*keys).agg(F.min(F.struct("borda", "model")).alias("_b")).select(*keys, F.col("_b.model").alias("_best"))
    return key_join(rows, best, keys).withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


def retrain_rows(df: DataFrame, keys: Sequence[str], rule: str, level: float = 0.85, min_rows: int | None = None) -> DataFrame:
    """Rows a model is retrained on: of high ``entropy`` or ``uncertainty``, outside the best ``confidence`` cell, or ``all``.

    Groups with too few such rows (100, or 1000 for ``all``) are left out.
    """
    condition = {
        "entropy": entropy(F.col("probability")) > level,
        "uncertainty": uncertainty(F.col("probability")) > level,
        "confidence": confidence_cell() != "best",
        "all": F.lit(True),
    }[rule]
    chosen = df.where(condition)
    sizes = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.col("_n") > 1000 if rule == "all" else F.col("_n") >= 100
    if min_rows is not None:
        enough = F.col("_n") >= min_rows
    return Groups.measure(df, keys).join(chosen, sizes.where(enough).drop("_n"), "left_semi")


def needs_renewal(scores: DataFrame, accuracy: float = 0.8) -> DataFrame:
    return scores.withColumn("renew", F.col("accuracy") < accuracy)


def admission(scores: DataFrame, cases: DataFrame, keys: Sequence[str], accuracy: float = 0.8, best_share: float = 0.7) -> DataFrame:
    """Per window: a new model group on all rows, a new member on the rows outside the best cell, or nothing."""
    joined = key_join(scores.select(*keys, "accuracy"), cases, keys)
    share = ratio(F.col("best_case"), F.col("num_io"))
    rule = F.when(F.col("accuracy") < accuracy, "new_group").when(share < best_share, "new_member").otherwise("none")
    rest = F.col("num_io") - F.col("best_case")
    rows = F.when(F.col("admit") == "new_group", F.col("num_io")).when(F.col("admit") == "new_member", rest).otherwise(0)
    return joined.withColumn("best_ratio", share).withColumn("admit", rule).withColumn("train_rows", rows).select(*keys, "accuracy", "best_ratio", "admit", "train_rows")


def nested_means(df: DataFrame, inner: Sequence[str], outer: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean over repetitions first, then over the inner keys that are not outer ones."""
    first = df.groupBy(*inner).agg(*[F.avg(c).alias(c) for c in columns])
    return first.groupBy(*outer).agg(*[F.avg(c).alias(c) for c in columns])


def rank_by_mean(results: DataFrame, metric: str, key: str = "algo") -> DataFrame:
    return results.groupBy(key).agg(F.avg(metric).alias(metric)).orderBy(F.desc(metric), key)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every two columns, from one pass over the rows."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (at least 1e-7) of every column, as one row."""
    sums = [F.avg(c).alias(f"{c}_mean") for c in columns]
    return df.agg(*sums, *[F.greatest(F.stddev_samp(c), F.lit(1e-7)).alias(f"{c}_std") for c in columns])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    joined = df.join(F.broadcast(scaler))  # one row
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    return joined.withColumns(scaled).drop(*scaler.columns)
