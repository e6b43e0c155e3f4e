"""Clustering and classification with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.features import FEATURES

# fixed values: hidden layers of the accept/reject model
HIDDEN = (128, 16)


def assemble(df: DataFrame, columns: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    rows = df.dropna(subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(rows)


def standardise(df: DataFrame, column: str = "features", out: str = "scaled") -> DataFrame:
    """z-score of every component."""
    return StandardScaler(inputCol=column, outputCol=out, withMean=True, withStd=True).fit(df).transform(df)


def kmeans_scores(df: DataFrame, ks: Sequence[int] = range(2, 20), column: str = "scaled", seed: int = 42) -> DataFrame:
    """Inertia and silhouette per number of clusters. The loop is over ``ks`` only; fits and scores run on Spark."""
    evaluator = ClusteringEvaluator(featuresCol=column)
    rows = []
    for k in ks:
        model = KMeans(featuresCol=column, k=k, seed=seed).fit(df)
        rows.append((int(k), float(model.summary.trainingCost), float(evaluator.evaluate(model.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans(df: DataFrame, k: int, column: str = "scaled", seed: int = 42) -> DataFrame:
    model = KMeans(featuresCol=column, k=k, seed=seed, predictionCol="cluster").fit(df)
    return model.transform(df)


def principal_components(df: DataFrame, k: int = 2, column: str = "scaled") -> DataFrame:
    rows = PCA(k=k, inputCol=column, outputCol="_pca").fit(df).transform(df)
    parts = vector_to_array("_pca")
    return rows.withColumns({f"pc{i + 1}": parts[i] for i in range(k)}).drop("_pca")


def centroids(df: DataFrame, cluster: str, values: str) -> DataFrame:
    """Mean per cluster and dimension of an array column."""
    long = df.select(cluster, F.posexplode(values).alias("dimension", "_v"))
    return long.groupBy(cluster, "dimension").agg(F.avg(F.col("_v").cast("double")).alias("mean"))


def fit_classifier(df: DataFrame, kind: str = "logistic", seed: int = 42, iterations: int = 30):
    """Accept/reject model on scaled features: ``logistic`` or ``perceptron`` (11-128-16-2)."""
    if kind == "perceptron":
        layers = [len(FEATURES), *HIDDEN, 2]
        estimator = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="reject", layers=layers, maxIter=iterations, seed=seed)
    else:
        estimator = LogisticRegression(featuresCol="scaled", labelCol="reject", maxIter=iterations, standardization=False)
    return estimator.fit(df)


def score(model, df: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``label``, ``prediction`` and ``probability`` of rejection."""
    rows = model.transform(df)
    p = vector_to_array("probability")[1]
    return rows.select(*keys, F.col("reject").alias("label"), (p > threshold).cast("int").alias("prediction"), p.alias("probability"))


def leaf_profile(df: DataFrame, model_column: str, trees: int = 5, depth: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Leaves of every row in a small forest, and rows per (tree, leaf, model)."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="reject", numTrees=trees, maxDepth=depth, seed=seed, leafCol="_leaves")
    rows = forest.fit(df).transform(df)
    leaves = rows.select("*", F.posexplode(vector_to_array("_leaves")).alias("tree", "_leaf")).withColumn("leaf", F.col("_leaf").cast("long"))
    leaves = leaves.drop("_leaves", "_leaf", "rawPrediction", "probability", "prediction")
    counts = leaves.groupBy("tree", "leaf", F.col(model_column).alias("model")).agg(F.count(F.lit(1)).alias("count"))
    return leaves, counts
