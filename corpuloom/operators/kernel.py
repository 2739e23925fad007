"""Kernel machines: five types by sequential minimal optimization, one model per group that fits a task;
larger groups by the same problem's decomposition over the cluster (operators/large_kernel.py)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators.optimize import lbfgs
from corpuloom.session import ship

TYPES = ("c_svc", "nu_svc", "one_class", "epsilon_svr", "nu_svr")
KERNELS = ("linear", "poly", "rbf", "sigmoid", "precomputed")


def gram(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    if kernel == "precomputed":
        return a
    d = a @ b.T
    if kernel == "linear":
        return d
    if kernel == "poly":
        return (gamma * d + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * d + coef0)
    if kernel == "rbf":
        return np.exp(-gamma * ((a * a).sum(1)[:, None] - 2 * d + (b * b).sum(1)[None, :]))
    raise ValueError(f"kernel must be one of {KERNELS}")


def smo(q: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray, x: np.ndarray, apart: bool = False, tolerance: float = 1e-3, most: int = 100_000):
    """min 1/2 x'Qx + p'x with y'x fixed and 0 <= x <= c, from a feasible x.

    The pair that violates optimality most moves; with ``apart`` both have the same sign of y, which
    fixes the sum of x too. Returns x and the gradient.
    """
    x = x.copy()
    g = q @ x + p
    for _ in range(most):
        up = np.where(y > 0, x < c - 1e-12, x > 1e-12)
        down = np.where(y > 0, x > 1e-12, x < c - 1e-12)
        score, best = -y * g, None
        for sign in (1, -1) if apart else (0,):
            side = np.ones(len(y), bool) if sign == 0 else y == sign
            if not (up & side).any() or not (down & side).any():
                continue
            i = int(np.argmax(np.where(up & side, score, -np.inf)))
            j = int(np.argmin(np.where(down & side, score, np.inf)))
            if best is None or score[i] - score[j] > best[0]:
                best = (score[i] - score[j], i, j)
        if best is None or best[0] < tolerance:
            break
        gap, i, j = best
        curve = q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j]
        t = gap / max(curve, 1e-12)
        t = min(t, c[i] - x[i] if y[i] > 0 else x[i], x[j] if y[j] > 0 else c[j] - x[j])
        di, dj = y[i] * t, -y[j] * t
        x[i] += di
        x[j] += dj
        g += q[:, i] * di + q[:, j] * dj
    return x, g


def _offset(x, g, y, c) -> float:
    free = (x > 1e-9) & (x < c - 1e-9)
    if free.any():
        return float((y * g)[free].mean())
    up, down = np.where(y > 0, x < c - 1e-9, x > 1e-9), np.where(y > 0, x > 1e-9, x < c - 1e-9)
    hi, lo = (y * g)[down].max(initial=-np.inf), (y * g)[up].min(initial=np.inf)
    return float(np.nan_to_num((hi + lo) / 2, posinf=0, neginf=0))


@dataclass
class Machine:
    kind: str
    kernel: str
    options: dict
    vectors: np.ndarray
    coefficients: np.ndarray
    rho: float
    classes: list = field(default_factory=list)
    platt: tuple[float, float] | None = None
    parts: list = field(default_factory=list)  # pairs of classes

    def decision(self, x: np.ndarray) -> np.ndarray:
        return gram(x, self.vectors, self.kernel, **self.options) @ self.coefficients - self.rho

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.parts:
            votes = np.zeros((len(x), len(self.classes)))
            for a, b, m in self.parts:
                won = m.decision(x) > 0
                votes[:, a] += won
                votes[:, b] += ~won
            return np.array(self.classes)[votes.argmax(1)]
        z = self.decision(x)
        if self.kind in ("epsilon_svr", "nu_svr"):
            return z
        if self.kind == "one_class":
            return np.where(z > 0, 1, -1)
        return np.where(z > 0, self.classes[0], self.classes[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of each class, coupled from the pairs' sigmoids."""
        if not self.parts:
            p = sigmoid(self.decision(x), *self.platt)
            return np.stack([p, 1 - p], 1)
        out = []
        for row in x:
            r = np.zeros((len(self.classes),) * 2)
            for a, b, m in self.parts:
                r[a, b] = np.clip(sigmoid(m.decision(row[None, :]), *m.platt)[0], 1e-7, 1 - 1e-7)
                r[b, a] = 1 - r[a, b]
            out.append(couple(r))
        return np.array(out)


def sigmoid(z, a, b):
    return 1 / (1 + np.exp(np.clip(a * z + b, -500, 500)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid of decisions z for outcomes y > 0, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def f(w):
        u = w[0] * z + w[1]
        value = (t * u + np.logaddexp(0, -u)).sum()
        d = t - 1 / (1 + np.exp(u))
        return float(value), np.array([d @ z, d.sum()])

    return tuple(lbfgs(f, np.array([0.0, np.log((n0 + 1) / (n1 + 1))]), rounds=100).x)


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities nearest to pairwise ones: minimize the sum of (r_ji p_i - r_ij p_j)^2 on the simplex."""
    k = len(r)
    q = -r * r.T
    np.fill_diagonal(q, (r * r).sum(0) - np.diag(r) ** 2)
    system = np.block([[q, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    p = np.linalg.lstsq(system, np.append(np.zeros(k), 1), rcond=None)[0][:k]
    p = np.maximum(p, 0)
    return p / p.sum()


def train(x: np.ndarray, y: np.ndarray, kind: str = "c_svc", kernel: str = "rbf", c: float = 1.0, nu: float = 0.5, epsilon: float = 0.1, probability: bool = False, class_weights: dict | None = None, **options) -> Machine:
    if kind not in TYPES:
        raise ValueError(f"kind must be one of {TYPES}")
    n = len(x)
    k = gram(x, x, kernel, **options)
    if kind == "one_class":
        start = np.zeros(n)
        whole = int(nu * n)
        start[:whole] = 1
        if whole < n:
            start[whole] = nu * n - whole
        a, g = smo(k, np.zeros(n), np.ones(n), np.ones(n), start)
        return Machine(kind, kernel, options, x, a, _offset(a, g, np.ones(n), np.ones(n)))
    if kind in ("epsilon_svr", "nu_svr"):
        s = np.concatenate([np.ones(n), -np.ones(n)])
        q = np.block([[k, -k], [-k, k]])
        limit = np.full(2 * n, c)
        if kind == "epsilon_svr":
            a, g = smo(q, np.concatenate([epsilon - y, epsilon + y]), s, limit, np.zeros(2 * n))
            rho = _offset(a, g, s, limit)
        else:
            left, start = c * nu * n / 2, np.zeros(2 * n)
            for i in range(n):
                start[i] = start[i + n] = min(left, c)
                left -= start[i]
            a, g = smo(q, np.concatenate([-y, y]), s, limit, start, apart=True)
            rho = _apart_offset(a, g, s, limit)[1]
        return Machine(kind, kernel, options, x, a[:n] - a[n:], rho)
    classes = sorted(set(y.tolist()), reverse=True)
    if len(classes) == 1:
        return Machine(kind, kernel, options, x[:1], np.zeros(1), -1.0, classes * 2)
    if len(classes) > 2:
        parts = []
        for i in range(len(classes)):
            for j in range(i + 1, len(classes)):
                rows = np.isin(y, [classes[i], classes[j]])
                parts.append((i, j, train(x[rows], y[rows], kind, kernel, c, nu, epsilon, probability, class_weights, **options)))
        return Machine(kind, kernel, options, x[:0], np.zeros(0), 0.0, classes, parts=parts)
    s = np.where(y == classes[0], 1.0, -1.0)
    q = k * s[:, None] * s[None, :]
    if kind == "c_svc":
        limit = c * np.array([(class_weights or {}).get(v, 1.0) for v in y.tolist()])
        a, g = smo(q, -np.ones(n), s, limit, np.zeros(n))
        coefficients, rho = a * s, _offset(a, g, s, limit)
    else:
        start = np.zeros(n)
        for sign in (1, -1):
            left = nu * n / 2
            for i in np.flatnonzero(s == sign):
                start[i] = min(1.0, left)
                left -= start[i]
        a, g = smo(q, np.zeros(n), s, np.ones(n), start, apart=True)
        r, rho = _apart_offset(a, g, s, np.ones(n))
        r = r if abs(r) > 1e-12 else 1.0
        coefficients, rho = a * s / r, rho / r
    kept = np.abs(coefficients) > 1e-12
    machine = Machine(kind, kernel, options, x if kernel == "precomputed" else x[kept], coefficients if kernel == "precomputed" else coefficients[kept], rho, classes)
    if probability:
        machine.platt = platt(k @ coefficients - rho, s)
    return machine


def _apart_offset(a, g, s, limit) -> tuple[float, float]:
    r1, r2 = (_offset(a[s == sign], g[s == sign], np.ones((s == sign).sum()), limit[s == sign]) for sign in (1, -1))
    return (r1 + r2) / 2, (r1 - r2) / 2


def by_group(spark: SparkSession, rows: DataFrame, group: str = "group", most: int = 5000, working: int = 512, **options) -> DataFrame:
    """One machine per group (rows: group, id, y, x; y null where to predict): group, id, pred (null in a group without a label).

    A group of up to ``most`` rows, those to predict included, is fitted in one task, which holds its kernel. Larger ones
    are solved over the whole cluster to the same optimality, ``working`` variables at a time; precomputed kernels, whose rows are as long as the group, raise there.
    """
    ship(spark)
    large = [r[group] for r in rows.groupBy(group).count().where(F.col("count") > most).select(group).collect()]  # a row per ``most`` rows at most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, known = np.stack(pdf["x"].to_numpy()), pdf["y"].notna().to_numpy()
        pred = np.full(len(pdf), np.nan)
        if known.any():
            pred = train(x[known], pdf["y"].to_numpy(float)[known], **options).predict(x).astype(float)
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "pred": pred})

    kind = rows.schema[group].dataType.simpleString()
    named = spark.createDataFrame([(v,) for v in large], f"_large {kind}")
    small = rows.join(F.broadcast(named), F.col(group).eqNullSafe(F.col("_large")), "left_anti") if large else rows
    out = small.groupBy(group).applyInPandas(run, f"{group} {kind}, id long, pred double")
    if large:
        from corpuloom.operators import large_kernel

        out = out.unionByName(large_kernel.by_group(spark, rows, group, large, working=working, **options))
    return out


def fourier(vector: Column, size: int, features: int = 256, gamma: float = 1.0, seed: int = 1) -> Column:
    """Random features whose inner products approach the RBF kernel, as built-in column functions."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (features, size))
    b = rng.uniform(0, 2 * np.pi, features)
    from corpuloom.functions.arrays import dot

    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in r]).alias("w"), F.lit(float(o)).alias("b")) for r, o in zip(w, b)])
    return F.transform(rows, lambda r: F.cos(dot(vector, r["w"]) + r["b"]) * float(np.sqrt(2 / features)))
