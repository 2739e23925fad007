"""Groups of features by how models of different folds weigh them.

Every fold has a linear model fitted on the rows outside it, all of them in the same passes over the rows: a pass sums
value, gradient or Hessian products of all folds' models at once, each row counting for the folds it is not in. The
models are one separable problem, solved by trust-region Newton steps. A feature's vector is its weight in each fold's
model; features with a weight are grouped by spherical k-means over these vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import linear as L
from corpuloom.operators.clusters import cosine_kmeans
from corpuloom.operators.optimize import Result, trust_region
from corpuloom.session import ship

LOSSES = ("logistic", "squared_hinge", "squared_epsilon")


def _folded(batches: Iterator[pa.RecordBatch], w: np.ndarray, v: np.ndarray | None, what: str, loss: str, epsilon: float):
    """Partial sums over the folds' models (a row of w each) of the value and gradient, the Hessian's diagonal, or its product with v."""
    total, value = np.zeros_like(w), 0.0
    for batch in batches:
        rows, fold = L.Sparse(batch), batch.column("fold").to_numpy()
        z = rows.margins(w)
        along = rows.margins(v) if v is not None else None
        d = np.zeros_like(z)
        for k in range(len(w)):
            counts = rows.weight * (fold != k)
            if what == "gradient":
                lost, slope = L._loss(loss, z[:, k : k + 1], rows.y, epsilon)
                value += float((counts * lost).sum())
                d[:, k] = counts * slope[:, 0]
            else:
                d[:, k] = counts * L._curve(loss, z[:, k : k + 1], rows.y, epsilon)[:, 0] * (1 if along is None else along[:, k])
        total += rows.back(d, w.shape[1] - 1, 2 if what == "diagonal" else 1)
    yield L._sums(total, value)


def fit(spark: SparkSession, rows: DataFrame, features: int, folds: int, loss: str = "squared_hinge", c: float = 1.0, epsilon: float = 0.1, rounds: int = 60, tolerance: float = 1e-6) -> L.Linear:
    """rows (fold from 0, y, idx, val, weight optional) -> a model whose row k is fitted on the rows outside fold k."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if folds * (features + 1) > L.MOST_WEIGHTS:
        raise ValueError("too many weights for the driver")
    ship(spark)
    held, classes = _with_fold(rows, features, loss)
    held = held.cache()
    shape, passes = (folds, features + 1), [0]

    def sums(what: str, w: np.ndarray, v: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        passes[0] += 1
        run = partial(_folded, w=w.reshape(shape), v=None if v is None else v.reshape(shape), what=what, loss=loss, epsilon=epsilon)
        got = held.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # as long as the weights
        head = got["i"].to_numpy() < 0
        out = np.zeros(w.size)
        out[got["i"].to_numpy()[~head]] = got["x"].to_numpy()[~head]
        return float(got["x"].to_numpy()[head].sum()), out

    def f(w: np.ndarray):
        value, g = sums("gradient", w)
        return 0.5 * float(w @ w) + c * value, w + c * g

    def curvature(w: np.ndarray):
        return lambda v: v + c * sums("product", w, v)[1], 1 + c * sums("diagonal", w)[1]

    out: Result = trust_region(f, curvature, np.zeros(folds * (features + 1)), rounds, tolerance)
    out.passes = passes[0]
    held.unpersist()
    return L.Linear(out.x.reshape(shape), classes, loss, out)


def _with_fold(rows: DataFrame, features: int, loss: str) -> tuple[DataFrame, list]:
    """Rows as the solvers take them, with their fold; and the two classes, lesser first, if there are classes."""
    classes = L.prepared(rows, features, loss)[1]
    sign = F.when(F.col("y") == classes[0], -1.0).when(F.col("y") == classes[1], 1.0) if classes else F.col("y").cast("double")
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    return rows.select(
        F.col("fold").cast("int").alias("fold"), sign.alias("y"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"), weight.cast("double").alias("weight")
    ), classes


def vectors(spark: SparkSession, model: L.Linear) -> DataFrame:
    """id (the feature, the bias left out), vector (its weight in each fold's model) of the features with a weight."""
    w = model.weights[:, :-1]
    held = np.flatnonzero(np.abs(w).sum(0) > 0)
    return spark.createDataFrame([(int(i), w[:, i].tolist()) for i in held], "id long, vector array<double>")


def groups(spark: SparkSession, rows: DataFrame, features: int, folds: int, k: int, **options) -> DataFrame:
    """id, cluster of the features: the whole chain from rows with a fold to groups of features."""
    return cosine_kmeans(vectors(spark, fit(spark, rows, features, folds, **options)), k)[1]
