"""Clustering: cosine k-means on documents, profiles or feature columns; counts of clusters and their links."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine_kmeans(rows: DataFrame, k: int, seed: int = 1, rounds: int = 30) -> tuple[KMeansModel, DataFrame]:
    """rows (id, vector: array) -> the model and (id, cluster). Zero vectors have no direction and are left out."""
    usable = rows.where(F.exists("vector", lambda x: x != 0)).select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(usable)
    return model, model.transform(usable).select("id", F.col("prediction").alias("cluster"))


def assign(model: KMeansModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return out.select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("vector"))


def link_counts(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between clusters: a, b, n (symmetric edges counted in both directions)."""
    a, b = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("a")), clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def language_model(clusters: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Term counts of each cluster."""
    return counts.join(clusters.select(F.col("id").alias(key), "cluster"), key).groupBy("cluster", "term").agg(F.sum("tf").alias("tf"))
