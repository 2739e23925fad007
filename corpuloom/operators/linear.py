"""Linear classifiers and regressors on sparse rows, by distributed gradients.

Rows: y, idx (array of feature indices from 0), val, weight (optional). A bias is one more feature
of value 1, penalized like the others. A gradient is as long as the features (times the classes),
which is checked; each evaluation is one pass over the cached rows, and partitions give one partial
gradient each (an array, not a row per weight), summed by array. For L-BFGS, losses without a gradient at their corner have it
rounded off; operators/dual.py solves them as they are. Smooth losses can also be solved by trust-region
Newton steps, whose Hessian-vector products are a pass each. operators/sparse_linear.py has the L1 penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.functions.special import logsumexp
from corpuloom.operators.optimize import Result, lbfgs, trust_region
from corpuloom.operators.topics import summed_arrays
from corpuloom.session import ship

MOST_WEIGHTS = 20_000_000
LOSSES = ("logistic", "hinge", "squared_hinge", "epsilon", "squared_epsilon", "multinomial", "crammer_singer")
REGRESSION = ("epsilon", "squared_epsilon")
#: Losses with a second derivative (almost everywhere).
CURVED = ("logistic", "squared_hinge", "squared_epsilon", "multinomial")
#: Partitions of the rows for each core, at most: each gives a gradient of the model's size in every pass.
PARTS = 2
#: Losses with a corner are quadratic over so much of the margin behind it, which moves a value by half of that at most.
CORNER = 0.01


@dataclass
class Linear:
    weights: np.ndarray  # classes x (features + bias); one row for two classes and for regression
    classes: list
    loss: str
    fitted: Result | None = None


def _cornered(x: np.ndarray, corner: float = CORNER) -> tuple[np.ndarray, np.ndarray]:
    """max(0, x) with its corner rounded off, and the slope."""
    slope = np.clip(x / corner, 0, 1)
    return np.where(x > corner, x - corner / 2, slope * slope * corner / 2), slope


def _margins_of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each class's margin over the own class, plus one for the wrong ones."""
    place = y.astype(int)
    out = z - z[np.arange(len(y)), place][:, None] + 1
    out[np.arange(len(y)), place] = 0
    return out


def _loss(loss: str, z: np.ndarray, y: np.ndarray, epsilon: float, corner: float = CORNER) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives by the margins z (rows x outputs); y is a sign, a class place or a number."""
    if loss == "logistic":
        m = y * z[:, 0]
        return np.logaddexp(0, -m), (-y / (1 + np.exp(m)))[:, None]
    if loss == "hinge":
        value, slope = _cornered(1 - y * z[:, 0], corner)
        return value, (-y * slope)[:, None]
    if loss == "epsilon":
        gap = z[:, 0] - y
        value, slope = _cornered(np.abs(gap) - epsilon, corner)
        return value, (np.sign(gap) * slope)[:, None]
    if loss == "squared_hinge":
        gap = np.maximum(0, 1 - y * z[:, 0])
        return gap**2, (-2 * y * gap)[:, None]
    if loss == "squared_epsilon":
        gap = z[:, 0] - y
        over = np.sign(gap) * np.maximum(0, np.abs(gap) - epsilon)
        return over**2, (2 * over)[:, None]
    place = y.astype(int)
    rows = np.arange(len(y))
    if loss == "class_margin":  # the greatest margin, smoothed as by a temperature
        margins = _margins_of(z, y) / corner
        log_sum = logsumexp(margins, axis=1)
        d = np.exp(margins - log_sum[:, None])
        d[rows, place] -= 1
        return corner * log_sum, d
    if loss == "multinomial":
        log_sum = logsumexp(z, axis=1)
        d = np.exp(z - log_sum[:, None])
        value = log_sum - z[rows, place]
        d[rows, place] -= 1
        return value, d
    margins = _margins_of(z, y)  # squared gap to the best wrong class
    worst = margins.argmax(1)
    gap = np.maximum(margins[rows, worst], 0)
    d = np.zeros_like(z)
    d[rows, worst] += 2 * gap
    d[rows, place] -= 2 * gap
    return gap**2, d


def _curve(loss: str, z: np.ndarray, y: np.ndarray, epsilon: float, corner: float = CORNER) -> np.ndarray:
    """Second derivatives by the margins (rows x 1), or class probabilities (rows x classes) of which the curvature of several outputs is made."""
    if loss in ("hinge", "epsilon"):
        x = 1 - y * z[:, 0] if loss == "hinge" else np.abs(z[:, 0] - y) - epsilon
        return ((x > 0) & (x < corner))[:, None] / corner
    if loss == "class_margin":
        margins = _margins_of(z, y) / corner
        return np.exp(margins - logsumexp(margins, axis=1)[:, None])
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.abs(z)))
        return p * (1 - p)
    if loss == "squared_hinge":
        return 2.0 * (y * z[:, 0] < 1)[:, None]
    if loss == "squared_epsilon":
        return 2.0 * (np.abs(z[:, 0] - y) > epsilon)[:, None]
    return np.exp(z - logsumexp(z, axis=1)[:, None])


class Sparse:
    """The rows of a batch as parallel arrays: y, weight, and for each cell its row, feature and value."""

    def __init__(self, batch: pa.RecordBatch):
        self.y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        self.weight = batch.column("weight").to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.y)), np.diff(batch.column("idx").offsets.to_numpy()))  # flatten() follows a slice
        self.i, self.v = batch.column("idx").flatten().to_numpy(), batch.column("val").flatten().to_numpy()

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[k, self.i] * self.v, len(self.y)) + w[k, -1] for k in range(len(w))], 1)

    def back(self, d: np.ndarray, features: int, power: int = 1) -> np.ndarray:
        """The sum of d (rows x outputs) times the rows' features, to a power, outputs x (features + bias)."""
        v = self.v**power
        return np.stack([np.append(np.bincount(self.i, d[self.row, k] * v, features), d[:, k].sum()) for k in range(d.shape[1])])


def _sums(total: np.ndarray, head: float = 0.0) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([head, *total.ravel()[at].tolist()], pa.float64())], ["i", "x"])


def _curved(batches: Iterator[pa.RecordBatch], w: np.ndarray, v: np.ndarray | None, loss: str, epsilon: float, corner: float = CORNER):
    """Partial sums of the losses' Hessian times v; of its diagonal where v is None."""
    total = np.zeros_like(w)
    for batch in batches:
        rows = Sparse(batch)
        curve = _curve(loss, rows.margins(w), rows.y, epsilon, corner)
        many, heat = loss in ("multinomial", "class_margin"), corner if loss == "class_margin" else 1.0
        if v is None:
            d = curve * (1 - curve) / heat if many else curve
        else:
            along = rows.margins(v)
            d = curve * (along - (curve * along).sum(1)[:, None]) / heat if many else curve * along
        total += rows.back(d * rows.weight[:, None], w.shape[1] - 1, 2 if v is None else 1)
    yield _sums(total)


def _gradient(batches: Iterator[pa.RecordBatch], w: np.ndarray, loss: str, epsilon: float, corner: float = CORNER):
    total, g = 0.0, np.zeros_like(w)
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        c = batch.column("weight").to_numpy(zero_copy_only=False)
        idx, val = batch.column("idx"), batch.column("val")
        counts = np.diff(idx.offsets.to_numpy())
        i, v = idx.flatten().to_numpy(), val.flatten().to_numpy()
        row = np.repeat(np.arange(len(y)), counts)
        z = np.stack([np.bincount(row, w[k, i] * v, len(y)) + w[k, -1] for k in range(len(w))], 1)
        f, d = _loss(loss, z, y, epsilon, corner)
        total += float((c * f).sum())
        d = d * c[:, None]
        for k in range(len(w)):
            g[k, :-1] += np.bincount(i, d[row, k] * v, w.shape[1] - 1)
        g[:, -1] += d.sum(0)
    lists = pa.ListArray.from_arrays(np.append(0, 1 + np.arange(len(w) + 1) * w.shape[1]).astype(np.int32), np.append(total, g.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(w)), pa.int64()), lists], ["k", "g"])


def _curvatures(loss: str, z: np.ndarray, y: np.ndarray, epsilon: float, corner: float) -> np.ndarray:
    """Second derivatives by pairs of outputs: outputs x outputs x rows."""
    curve = _curve(loss, z, y, epsilon, corner)
    if loss not in ("multinomial", "class_margin"):
        return curve.T[None]
    heat = corner if loss == "class_margin" else 1.0
    p = curve.T
    return (np.eye(len(p))[:, :, None] * p[:, None, :] - p[:, None, :] * p[None, :, :]) / heat


def _hessian(batches: Iterator[pa.RecordBatch], w: np.ndarray, loss: str, epsilon: float, corner: float):
    """Partial sums of the losses' whole Hessian, the upper triangle in a line."""
    outputs, width = w.shape
    total = np.zeros((w.size, w.size))
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            rows = Sparse(batch.slice(at, 2048))
            x = np.zeros((len(rows.y), width))
            np.add.at(x, (rows.row, rows.i), rows.v)
            x[:, -1] = 1
            curves = _curvatures(loss, x @ w.T, rows.y, epsilon, corner) * rows.weight
            for a in range(outputs):
                for b in range(a, outputs):
                    total[a * width : (a + 1) * width, b * width : (b + 1) * width] += (x * curves[a, b][:, None]).T @ x
    yield _sums(total[np.triu_indices(w.size)])


#: Weights up to which the whole Hessian is summed in one pass; beyond it each of its products is a pass.
DIRECT = 512


def curvature(rows: DataFrame, shape: tuple[int, int], loss: str, c: float, epsilon: float, corner: float = CORNER, passes: list[int] | None = None):
    """The Hessian of the objective at w, as products with vectors and as its diagonal; one pass in all for few weights, else a pass each."""
    size = shape[0] * shape[1]
    passes = passes if passes is not None else [0]

    def direct(w: np.ndarray):
        passes[0] += 1
        parts = rows.mapInArrow(partial(_hessian, w=w.reshape(shape), loss=loss, epsilon=epsilon, corner=corner), "i long, x double")
        sums = parts.where("i >= 0").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # at most DIRECT squared
        upper = np.zeros(size * (size + 1) // 2)
        upper[sums["i"].to_numpy()] = sums["x"].to_numpy()
        h = np.zeros((size, size))
        h[np.triu_indices(size)] = c * upper
        h = h + np.triu(h, 1).T + np.eye(size)
        return lambda v: h @ v, np.diag(h).copy()

    if size <= DIRECT:
        return direct

    def total(w, v):
        passes[0] += 1
        parts = rows.mapInArrow(partial(_curved, w=w, v=v, loss=loss, epsilon=epsilon, corner=corner), "i long, x double")
        sums = parts.where("i >= 0").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # as long as the weights
        out = np.zeros(w.size)
        out[sums["i"].to_numpy()] = sums["x"].to_numpy()
        return out

    def at(w: np.ndarray):
        w = w.reshape(shape)
        return lambda v: v + c * total(w, v.reshape(shape)), 1 + c * total(w, None)

    return at


def objective(rows: DataFrame, shape: tuple[int, int], loss: str, c: float, epsilon: float, corner: float = CORNER, passes: list[int] | None = None):
    """1/2 |w|^2 + C sum of losses, as a function of w for an optimizer."""
    passes = passes if passes is not None else [0]

    def f(w: np.ndarray):
        passes[0] += 1
        parts = rows.mapInArrow(partial(_gradient, w=w.reshape(shape), loss=loss, epsilon=epsilon, corner=corner), "k long, g array<double>")
        sums = summed_arrays(parts, "k", "g", w.size, most=4)  # as long as the weights
        value = float(sums.pop(-1, np.zeros(1))[0])
        g = np.concatenate([sums.get(k, np.zeros(shape[1])) for k in range(shape[0])])
        return 0.5 * float(w @ w) + c * value, w + c * g

    return f


def fit(
    spark: SparkSession, rows: DataFrame, features: int, loss: str = "logistic", c: float = 1.0, epsilon: float = 0.1, l1: bool = False, rounds: int = 60, class_weights: dict | None = None,
    solver: str = "lbfgs", tolerance: float = 1e-5, merge: bool = False,
) -> Linear:
    """l1 replaces 1/2 |w|^2 by the sum of |w| (proximal gradients). solver: lbfgs, or newton for losses of CURVED. merge: see merged()."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if solver not in ("lbfgs", "newton") or solver == "newton" and (loss not in CURVED or l1):
        raise ValueError(f"solver is lbfgs, or newton for one of {CURVED} without l1")
    ship(spark)
    data, classes, outputs = prepared(rows, features, loss, class_weights)
    data = (merged(data) if merge else data).coalesce(PARTS * spark.sparkContext.defaultParallelism).cache()
    shape = (outputs, features + 1)
    passes = [0]
    f = objective(data, shape, loss, c, epsilon, passes=passes)
    x0 = np.zeros(outputs * (features + 1))
    if l1:
        out = proximal(f, x0, rounds)
    elif solver == "newton":
        out = trust_region(f, curvature(data, shape, loss, c, epsilon, passes=passes), x0, rounds, tolerance)
    else:
        out = lbfgs(f, x0, rounds=rounds, tolerance=tolerance)
    out.passes = passes[0]
    data.unpersist()
    return Linear(out.x.reshape(shape), classes, loss, out)


def prepared(rows: DataFrame, features: int, loss: str, class_weights: dict | None = None) -> tuple[DataFrame, list, int]:
    """Rows as the solvers take them (y as a sign, class place or number; weight), the classes, and how many outputs there are."""
    classes: list = []
    if loss not in REGRESSION:
        most = MOST_WEIGHTS // (features + 1)  # more have no place in the model
        classes = sorted(r[0] for r in rows.select("y").distinct().limit(most + 1).collect())
    outputs = len(classes) if loss in ("multinomial", "crammer_singer") else 1
    if outputs * (features + 1) > MOST_WEIGHTS:
        raise ValueError("too many weights for the driver")
    if outputs == 1 and classes and len(classes) != 2:
        raise ValueError("a two-class loss needs two classes; use one_vs_rest or multinomial")
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    if class_weights:
        weight = weight * F.coalesce(*[F.when(F.col("y") == k, F.lit(float(x))) for k, x in class_weights.items()], F.lit(1.0))
    code: Column = F.col("y").cast("double")
    if classes:
        places = [(-1.0, 1.0)[k] if outputs == 1 else float(k) for k in range(len(classes))]
        code = F.coalesce(*[F.when(F.col("y") == y, F.lit(p)) for y, p in zip(classes, places)])
    return rows.select(code.alias("y"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"), weight.cast("double").alias("weight")), classes, outputs


def merged(data: DataFrame) -> DataFrame:
    """Prepared rows, equal ones as one with the sum of their weights: the same objective in as many rows as there are different ones.

    Worth one shuffle where features take few values; sums are combined before it.
    """
    return data.groupBy("y", "idx", "val").agg(F.sum("weight").alias("weight"))


def proximal(f, x0: np.ndarray, rounds: int, tolerance: float = 1e-6) -> Result:
    """Accelerated proximal gradients for |w|_1 + the losses (f's own |w|^2 / 2 is taken out)."""
    smooth = lambda w: (lambda v, g: (v - 0.5 * float(w @ w), g - w))(*f(w))
    shrink = lambda w, t: np.sign(w) * np.maximum(np.abs(w) - t, 0)
    x = y = np.array(x0, float)
    step, t, value = 1.0, 1.0, np.inf
    for r in range(rounds):
        fy, g = smooth(y)
        while True:
            new = shrink(y - step * g, step)
            d = new - y
            fn = smooth(new)[0]
            if fn <= fy + g @ d + d @ d / (2 * step) + 1e-12 or step < 1e-12:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        total = fn + np.abs(new).sum()
        if abs(value - total) <= tolerance * max(1.0, abs(total)):
            return Result(new, total, r, True)
        x, t, value = new, t_new, total
    return Result(x, value, rounds, False)


def _scored(batches, model):
    m: Linear = model.value
    for batch in batches:
        n = batch.num_rows
        i, v = batch.column("idx").flatten().to_numpy(), batch.column("val").flatten().to_numpy()
        row = np.repeat(np.arange(n), np.diff(batch.column("idx").offsets.to_numpy()))
        z = np.stack([np.bincount(row, w[i] * v, n) + w[-1] for w in m.weights], 1)
        if m.loss in REGRESSION:
            pred = z[:, 0]
        elif len(m.weights) == 1:
            pred = np.array(m.classes, float)[(z[:, 0] > 0).astype(int)]
        else:
            pred = np.array(m.classes, float)[z.argmax(1)]
        p = np.exp(z - logsumexp(z, axis=1)[:, None]) if len(m.weights) > 1 else 1 / (1 + np.exp(-np.hstack([-z, z])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(pred.astype(float)), pa.array(z.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64()))], ["id", "pred", "decision", "probability"]
        )


def predict(spark: SparkSession, rows: DataFrame, model: Linear) -> DataFrame:
    """rows with id, idx, val -> id, pred, decision values, probabilities (of logistic losses)."""
    ship(spark)
    data = rows.select(F.col("id").cast("long").alias("id"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"))
    return data.mapInArrow(partial(_scored, model=spark.sparkContext.broadcast(model)), "id long, pred double, decision array<double>, probability array<double>")


def svc(spark: SparkSession, rows: DataFrame, features: int, c: float = 1.0, rounds: int = 50) -> Linear:
    """The L2-regularized hinge loss; more than two classes one against the rest, a row of weights each."""
    most = MOST_WEIGHTS // (features + 1)
    classes = sorted(r[0] for r in rows.select("y").distinct().limit(most + 1).collect())
    if len(classes) <= 2:
        return fit(spark, rows, features, "hinge", c, rounds=rounds)
    if len(classes) > most:
        raise ValueError("too many weights for the driver")
    each = [fit(spark, rows.withColumn("y", (F.col("y") == k).cast("int")), features, "hinge", c, rounds=rounds) for k in classes]
    return Linear(np.concatenate([m.weights for m in each]), classes, "hinge")


def regression_figures(predictions: DataFrame) -> DataFrame:
    """Mean squared error and squared correlation of (pred, y)."""
    return predictions.agg(F.avg((F.col("pred") - F.col("y")) ** 2).alias("mse"), (F.corr("pred", "y") ** 2).alias("r2"))


def per_user(rows: DataFrame, weights: DataFrame, user: str = "user_id") -> DataFrame:
    """Decisions of a linear model of each user's own: rows (user, id, features (idx, val)), weights (user, w: bias first).

    w is one vector (pred: whether its decision is positive) or an array of a vector per class
    (pred: the place of the greatest decision, the first of equal ones).
    """
    from corpuloom.functions.arrays import argmax, sparse_dense_dot

    joined = rows.join(weights, user)
    if weights.schema["w"].dataType.simpleString().startswith("array<array"):
        z = F.transform("w", lambda w: sparse_dense_dot(F.col("features"), w, bias=True))
        return joined.withColumn("decision", z).withColumn("pred", argmax(F.col("decision")).cast("int")).drop("w")
    z = sparse_dense_dot(F.col("features"), F.col("w"), bias=True)
    return joined.withColumn("decision", z).withColumn("pred", (F.col("decision") > 0).cast("int")).drop("w")


def transposed(weights: DataFrame, key: str = "user_id", vector: str = "w") -> DataFrame:
    """Features as the instances: idx, values over the keys in order."""
    cells = weights.select(key, F.posexplode(vector).alias("idx", "x"))
    return cells.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct(key, "x")))["x"].alias("values"))


def cross_validate(spark: SparkSession, rows: DataFrame, features: int, folds: int = 5, standard: bool = True, **options) -> DataFrame:
    """fold, id, y, pred of rows with a fold. Not ``standard``: fold i learns from folds i + 1 and i + 2 only, and all others are tests."""
    out = None
    for i in range(folds):
        learn = F.col("fold") != i if standard else F.col("fold").isin((i + 1) % folds, (i + 2) % folds)
        model = fit(spark, rows.where(learn), features, **options)
        test = rows.where(~learn)
        got = predict(spark, test, model).join(test.select("id", "y"), "id").select(F.lit(i).alias("fold"), "id", "y", "pred")
        out = got if out is None else out.unionByName(got)
    return out


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.DoubleType()))])
