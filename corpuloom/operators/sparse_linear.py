"""Linear models under the L1 penalty: |w|_1 + C sum of losses, by blocks of features.

A round has three passes over the rows. The gradient tells which features can move: those with a weight, and
those whose gradient exceeds the penalty. These are dealt into blocks, and a second pass sums the curvature
within each block. Each block is a small problem of its own, solved by coordinate steps in a task of its own;
rows never move, and a task gets no more than its block's matrix. The blocks' steps together make one
direction; a third pass takes the value at a ladder of step lengths at once, and the best one is used. Where
all movable features fit one block, these are full proximal Newton steps; several blocks leave out the
curvature between them, for which the line search makes up.

Logistic and squared hinge losses of two classes, squared epsilon losses of regression. The bias is one more
feature and penalized like the others. A fit ends when the least subgradient is a stated share of its first
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import linear as L
from corpuloom.operators.optimize import Result
from corpuloom.session import ship

LOSSES = ("logistic", "squared_hinge", "squared_epsilon")
#: Features of a block: its matrix has the square of that.
BLOCK = 256
#: Cells of all blocks' matrices together, which is what a task of the second pass holds.
MOST_CELLS = 16_000_000
STEPS = tuple(0.5**k for k in range(-1, 14))


def subgradient(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least subgradient of |w|_1 plus a loss of gradient g: 0 at an optimum."""
    return np.where(w > 0, g + 1, np.where(w < 0, g - 1, np.sign(g) * np.maximum(np.abs(g) - 1, 0)))


def block_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, sweeps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """The d that minimizes g d + d'Hd / 2 + |w + d|_1, by coordinate steps."""
    h = h + 1e-10 * max(1.0, float(np.trace(h)) / len(h)) * np.eye(len(h))
    d, slope = np.zeros_like(w), g.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            here, curve = w[j] + d[j], h[j, j]
            goal = here - slope[j] / curve
            move = np.sign(goal) * max(abs(goal) - 1 / curve, 0.0) - here
            if move:
                d[j] += move
                slope += move * h[j]
                most = max(most, abs(move) * np.sqrt(curve))
        if most < tolerance:
            break
    return d


def _curvatures(batches: Iterator[pa.RecordBatch], w: np.ndarray, place: np.ndarray, size: int, loss: str, epsilon: float):
    """Partial sums of the curvature within blocks; place: each feature's place among the movable ones, or -1."""
    blocks = -(-int(place.max() + 1) // size)
    total = np.zeros(blocks * size * size)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = L.Sparse(batch.slice(at, 4096))
            curve = L._curve(loss, rows.margins(w), rows.y, epsilon)[:, 0] * rows.weight
            row = np.concatenate([rows.row, np.arange(len(rows.y))])
            i = np.concatenate([place[rows.i], np.full(len(rows.y), place[-1])])
            v = np.concatenate([rows.v, np.ones(len(rows.y))])
            held = i >= 0
            row, i, v = row[held], i[held], v[held]
            group = row * blocks + i // size
            order = np.argsort(group, kind="stable")
            group, i, v, row = group[order], i[order], v[order], row[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
            counts = np.diff(np.append(first, len(group)))
            # each cell of a row with each one of its block in that row
            n = np.repeat(counts, counts)
            left = np.repeat(np.arange(len(group)), n)
            right = np.repeat(np.repeat(first, counts), n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            key = i[left] // size * size * size + i[left] % size * size + i[right] % size
            np.add.at(total, key, curve[row[left]] * v[left] * v[right])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at // (size * size)), pa.array(at % (size * size)), pa.array(total[at])], ["block", "cell", "x"])


def _solved(frame: pd.DataFrame, w: np.ndarray, g: np.ndarray, size: int, c: float) -> pd.DataFrame:
    """One block: w and g of the movable features, in the order of their places."""
    block = int(frame["block"].iloc[0])
    mine = slice(block * size, min((block + 1) * size, len(w)))
    h = np.zeros(size * size)
    h[frame["cell"].to_numpy()] = c * frame["x"].to_numpy()
    n = mine.stop - mine.start
    d = block_step(w[mine], g[mine], h.reshape(size, size)[:n, :n])
    return pd.DataFrame({"i": np.arange(mine.start, mine.stop), "x": d})


def _values(batches: Iterator[pa.RecordBatch], w: np.ndarray, d: np.ndarray, loss: str, epsilon: float):
    total = np.zeros(len(STEPS))
    for batch in batches:
        rows = L.Sparse(batch)
        z, along = rows.margins(w), rows.margins(d)
        total += [float((rows.weight * L._loss(loss, z + t * along, rows.y, epsilon)[0]).sum()) for t in STEPS]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STEPS))), pa.array(total)], ["i", "x"])


def fit(
    spark: SparkSession, rows: DataFrame, features: int, loss: str = "logistic", c: float = 1.0, epsilon: float = 0.1, rounds: int = 100, tolerance: float = 1e-4,
    block: int = BLOCK, class_weights: dict | None = None,
) -> L.Linear:
    """Rows as linear.fit takes them. fitted.gap is the sum of the least subgradient's lengths at the end, fitted.passes the passes over the rows."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    ship(spark)
    data, classes, _ = L.prepared(rows, features, loss, class_weights)
    data = data.cache()
    passes, shape = [0], (1, features + 1)
    f = L.objective(data, shape, loss, c, epsilon, passes=passes)
    w, first, left, value, done = np.zeros(features + 1), None, np.inf, np.inf, False
    for r in range(rounds):
        value, g = f(w)
        value, g = value - 0.5 * float(w @ w), g - w  # without the other penalty
        value += float(np.abs(w).sum())
        left = float(np.abs(subgradient(w, g)).sum())
        first = left if first is None else first
        if left <= tolerance * max(first, 1e-300):
            done = True
            break
        movable = np.flatnonzero((w != 0) | (np.abs(g) > 1))
        size = int(max(1, min(block, len(movable), MOST_CELLS // len(movable))))
        place = np.full(features + 1, -1)
        place[movable] = np.arange(len(movable))
        cells = data.mapInArrow(partial(_curvatures, w=w[None], place=place, size=size, loss=loss, epsilon=epsilon), "block long, cell long, x double")
        cells = cells.groupBy("block", "cell").agg(F.sum("x").alias("x"))
        here, slope = w[movable], g[movable]

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            return _solved(frame, here, slope, size, c)  # noqa: B023

        moves = cells.groupBy("block").applyInPandas(solve, "i long, x double").toPandas()  # as long as the weights
        d = np.zeros(features + 1)
        d[movable[moves["i"].to_numpy(dtype=int)]] = moves["x"].to_numpy(dtype=float)
        values = data.mapInArrow(partial(_values, w=w[None], d=d[None], loss=loss, epsilon=epsilon), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        passes[0] += 2
        at = np.zeros(len(STEPS))
        at[values["i"].to_numpy()] = values["x"].to_numpy()
        totals = c * at + np.array([np.abs(w + t * d).sum() for t in STEPS])
        best = int(np.argmin(totals))
        if totals[best] >= value - 1e-14 * abs(value):
            break  # below what the sums can tell
        w = w + STEPS[best] * d
    data.unpersist()
    return L.Linear(w[None], classes, loss, Result(w, value, r + 1, done, passes[0], left))
