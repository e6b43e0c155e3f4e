"""Clustering, classifiers and update policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import evaluate as ev
from spindle.operators import features, joins, label, ml, policy
from spindle.plans.labels import features_of
from spindle.plans.registry import query, rounded
from spindle.session import stable
from spindle.sources import fixtures


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = fixtures.table(spark, folder, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return stable(ml.standardise(rows))


def training(spark: SparkSession, folder: str, per_window: int = 5) -> DataFrame:
    """Scaled features of the reads, rejected from the latency knee on; a window is ``per_window`` days."""
    # the knee takes several passes, which read the features instead of making them anew
    made = stable(features_of(spark, folder).select("event_id", "disk_id", "chunk", "io_type", "latency", *features.FEATURES))
    made = label.knee_label(made, ["disk_id", "chunk"]).withColumn("reject", F.col("slow"))
    reads = features.model_columns(made, ["event_id", "chunk"])
    rows = reads.withColumnRenamed("event_id", "row_id").withColumn("window_id", F.floor(F.col("chunk") / per_window))
    return stable(ml.standardise(ml.assemble(rows)))


@query("ml1_scaled_vectors")
def scaled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return vectors(spark, folder).select("vec_id", vector_to_array("scaled").alias("scaled"))


@query("ml2_kmeans_scores")
def kmeans_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ml.kmeans_scores(vectors(spark, folder), ks=range(2, 20))


@query("ml3_principal_components")
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    return ml.principal_components(vectors(spark, folder)).select("vec_id", "pc1", "pc2")


@query(
    "ml4_centroids",
    """SELECT label, CAST(d - 1 AS INTEGER) AS dimension, round(avg(CAST(embedding[d] AS DOUBLE)), 6) AS mean
  FROM embeddings, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS d) GROUP BY ALL""",
)
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ml.centroids(fixtures.table(spark, folder, "embeddings"), "label", "embedding"))


@query("ml5_reject_classifier")
def reject_classifier(spark: SparkSession, folder: str) -> DataFrame:
    rows = training(spark, folder)
    model = ml.fit_classifier(rows, "perceptron", iterations=15)
    return ev.evaluate(ml.score(model, rows, ["row_id", "window_id"]), ["window_id"])


@query("ev17_leaf_profile")
def leaf_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ml.leaf_profile(training(spark, folder), "window_id")[1]


@query("jn6_forest_overlap")
def forest_overlap(spark: SparkSession, folder: str) -> DataFrame:
    leaves, counts = ml.leaf_profile(training(spark, folder), "window_id")
    newest = leaves.where(F.col("chunk") % 5 == 4).select("tree", "leaf")
    return joins.leaf_overlap(newest, counts)


@query("ev21_policies")
def policies(spark: SparkSession, folder: str) -> DataFrame:
    rows = training(spark, folder, per_window=10)
    return policy.run_policies(rows, min_rows=50)
