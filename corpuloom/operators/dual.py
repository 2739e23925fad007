"""Linear machines solved in the dual: the losses as they are, corners included, with a certificate.

Every row has a dual value (one per class for the loss of Crammer and Singer), kept beside the row in a
state table of blocks; the weights are the sum of the rows times their dual values.

The start: Newton steps on the losses with their corners rounded off, ever less so. The slope
of a rounded loss is a feasible dual value, so what is left of the gap is about the corner's share.

Then rounds: each task goes over its blocks and moves one dual value after the other to its best place, as
if the tasks shared only the weights of the round's beginning, times a factor for what the others add. What
the tasks' moves do together is damped by the step that is best for the dual along their sum, found in
closed form from a few sums; it is applied to the dual values when the next round reads them. The dual value
so never falls, whatever the data, and the primal value of the same weights bounds what is left: a fit ends
when that gap is a stated share of the primal value. (From zero instead of from the start above, such rounds
take hundreds where features are shared by all tasks.)

Through the driver go the weights, one change of weights per round, and a handful of sums. Rows never
move after they were packed. A round writes the next state, which cuts lineage, and drops the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import linear as L
from corpuloom.operators.linear import REGRESSION, Linear, prepared
from corpuloom.operators.optimize import Result, searched_newton
from corpuloom.session import Scratch, ship, spread

LOSSES = ("hinge", "squared_hinge", "logistic", "epsilon", "squared_epsilon", "crammer_singer")
#: The loss whose rounded form the start takes, where it has another name.
_SMOOTH = {"crammer_singer": "class_margin"}
CORNERS = (1.0, 0.1, 0.01)
BLOCK_ROWS, BLOCK_CELLS = 4096, 400_000

#: A block: its rows' y, limit, number of cells, cells, dual values and pending moves; or, without rows, a task's sums.
STATE = "y array<double>, c array<double>, counts array<int>, idx array<int>, val array<double>, dual array<double>, move array<double>, at array<long>, change array<double>, sums array<double>"
_KINDS = {"array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _row(**columns) -> pa.RecordBatch:
    fields = [x.split(" ", 1) for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([columns.get(n)], _KINDS[k]) for n, k in fields], [n for n, _ in fields])


def _packed(batches: Iterator[pa.RecordBatch], outputs: int, c: float):
    """Rows as blocks, all dual values 0."""
    held: list[tuple] = []
    rows = cells = 0

    def block():
        y, w, n, i, v = (np.concatenate(x) for x in zip(*held))
        return _row(y=y, c=c * w, counts=n, idx=i, val=v, dual=np.zeros(len(y) * outputs), move=np.zeros(len(y) * outputs))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            column = lambda name: part.column(name).to_numpy(zero_copy_only=False).astype(float)
            idx, val = part.column("idx"), part.column("val")
            held.append((column("y"), column("weight"), np.diff(idx.offsets.to_numpy()), idx.flatten().to_numpy(), val.flatten().to_numpy()))
            rows, cells = rows + part.num_rows, cells + len(held[-1][3])
            if rows >= BLOCK_ROWS or cells >= BLOCK_CELLS:
                yield block()
                held, rows, cells = [], 0, 0
    if held:
        yield block()


def _started(batches: Iterator[pa.RecordBatch], w: np.ndarray, loss: str, epsilon: float, corner: float):
    """Blocks with the dual values that the slopes at w are, and the weights that these make."""
    total = np.zeros_like(w)
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda n: batch.column(n)[r].values.to_numpy(zero_copy_only=False)
            y, limit, counts, idx, val = (get(n) for n in ("y", "c", "counts", "idx", "val"))
            row = np.repeat(np.arange(len(y)), counts)
            z = np.stack([np.bincount(row, w[k, idx] * val, len(y)) + w[k, -1] for k in range(len(w))], 1)
            dual = -limit[:, None] * L._loss(_SMOOTH.get(loss, loss), z, y, epsilon, corner)[1]
            for k in range(len(w)):
                total[k, :-1] += np.bincount(idx, dual[row, k] * val, w.shape[1] - 1)
            total[:, -1] += dual.sum(0)
            yield _row(y=y, c=limit, counts=counts, idx=idx, val=val, dual=dual.ravel(), move=np.zeros(dual.size))
    change = total.ravel()
    places = np.flatnonzero(change)
    yield _row(at=places, change=change[places], sums=np.zeros(4))


def log_moved(alpha: float, slope: float, q: float, limit: float) -> float:
    """The best dual value of the logistic loss: where q (x - alpha) + slope + log(x / (limit - x)) is 0, by safeguarded Newton steps on the log odds."""
    low, high = -abs(slope) - q * limit - 1, abs(slope) + q * limit + 1
    u = min(max(np.log(max(alpha, 1e-300) / max(limit - alpha, 1e-300)), low), high)
    for _ in range(100):
        share = 1 / (1 + np.exp(-u)) if u > -700 else 0.0
        value = q * (limit * share - alpha) + slope + u
        if abs(value) < 1e-12:
            break
        low, high = (u, high) if value < 0 else (low, u)
        u -= value / (q * limit * share * (1 - share) + 1)
        if not low < u < high:
            u = (low + high) / 2
    return limit * share


def class_moved(z: np.ndarray, own: int, dual: np.ndarray, q: float, limit: float) -> np.ndarray:
    """The best dual values of one row over the classes: each at most its limit (0 but for the own class), their sum 0.

    They are min(limit, (beta - b) / q) for the one beta that makes the sum 0, found by sorting where they reach their limits.
    """
    b = z + 1 - q * dual
    b[own] -= 1
    top = np.zeros(len(z))
    top[own] = limit
    order = np.sort(b + q * top)[::-1]
    beta = (np.cumsum(order) - q * limit) / np.arange(1, len(z) + 1)
    below = np.append(order[1:], -np.inf)
    return np.minimum(top, (beta[np.argmax(beta >= below)] - b) / q)


def moved(loss: str, z, y: float, dual, q: float, limit: float, epsilon: float):
    """The best signed dual value of one row with margin z and squared length q."""
    if loss == "hinge":
        return y * min(max(y * dual - (y * z - 1) / q, 0.0), limit)
    if loss == "squared_hinge":
        d = 0.5 / limit
        return y * max(y * dual - (y * z - 1 + d * y * dual) / (q + d), 0.0)
    if loss == "logistic":
        return y * log_moved(y * dual, y * z, q, limit)
    d = 0.5 / limit if loss == "squared_epsilon" else 0.0
    goal = dual - (z - y + d * dual) / (q + d)
    goal = np.sign(goal) * max(abs(goal) - epsilon / (q + d), 0.0)
    return goal if loss == "squared_epsilon" else min(max(goal, -limit), limit)


def conjugates(loss: str, dual: np.ndarray, y: np.ndarray, limit: np.ndarray, epsilon: float) -> float:
    """The dual objective's other part: it is -|w|^2 / 2 minus this."""
    if loss == "crammer_singer":
        wrong = np.ones(dual.shape)
        wrong[np.arange(len(y)), y.astype(int)] = 0
        return float((wrong * dual).sum())
    if loss == "logistic":
        a = np.clip(y * dual, 0, limit)
        entropy = lambda x: x * np.log(np.where(x > 0, x, 1))
        return float((entropy(a) + entropy(limit - a) - entropy(limit)).sum())
    linear = -y * dual if loss.endswith("hinge") else epsilon * np.abs(dual) - y * dual
    return float((linear + (dual**2 / (4 * limit) if loss.startswith("squared") else 0)).sum())


def losses(loss: str, z: np.ndarray, y: np.ndarray, limit: np.ndarray, epsilon: float) -> float:
    """The primal objective's other part, limits included."""
    if loss == "crammer_singer":
        place = y.astype(int)
        gap = z + 1 - z[np.arange(len(y)), place][:, None]
        gap[np.arange(len(y)), place] = 0
        return float((limit * gap.max(1)).sum())
    z = z[:, 0]
    if loss == "logistic":
        return float((limit * np.logaddexp(0, -y * z)).sum())
    gap = np.maximum(0, 1 - y * z) if loss.endswith("hinge") else np.maximum(0, np.abs(z - y) - epsilon)
    return float((limit * (gap**2 if loss.startswith("squared") else gap)).sum())


def _round(batches: Iterator[pa.RecordBatch], w: np.ndarray, step: float, share: float, loss: str, epsilon: float, epochs: int, seed: int):
    """Apply the pending moves by ``step``, take the sums at w, and move the dual values against w plus ``share`` times the task's own changes."""
    outputs = len(w)
    v, sums = w.copy(), np.zeros(4)
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda n: batch.column(n)[r].values.to_numpy(zero_copy_only=False)
            y, limit, counts, idx, val = (get(n) for n in ("y", "c", "counts", "idx", "val"))
            n = len(y)
            at = np.concatenate([[0], np.cumsum(counts)])
            old = (get("dual") + step * get("move")).reshape(n, outputs)
            row = np.repeat(np.arange(n), counts)
            z = np.stack([np.bincount(row, w[k, idx] * val, n) + w[k, -1] for k in range(outputs)], 1)
            length = np.bincount(row, val * val, n) + 1
            signed = old if loss == "crammer_singer" else old[:, 0]
            sums[:2] += losses(loss, z, y, limit, epsilon), conjugates(loss, signed, y, limit, epsilon)
            new = old.copy()
            order = np.random.default_rng(seed + n)
            for _ in range(epochs):
                for i in order.permutation(n).tolist():
                    if limit[i] <= 0:
                        continue
                    cells, values = idx[at[i] : at[i + 1]], val[at[i] : at[i + 1]]
                    here = v[:, cells] @ values + v[:, -1]
                    q = share * length[i]
                    if loss == "crammer_singer":
                        to = class_moved(here, int(y[i]), new[i], q, limit[i])
                    else:
                        to = moved(loss, here[0], y[i], new[i, 0], q, limit[i], epsilon)
                    by = share * (to - new[i])
                    if by.any():
                        v[:, cells] += by[:, None] * values
                        v[:, -1] += by
                        new[i] = to
            signed = new if loss == "crammer_singer" else new[:, 0]
            sums[2] += conjugates(loss, signed, y, limit, epsilon)
            if loss.startswith("squared"):
                sums[3] += float(((new - old)[:, 0] ** 2 / (2 * limit)).sum())
            yield _row(y=y, c=limit, counts=counts, idx=idx, val=val, dual=old.ravel(), move=(new - old).ravel())
    change = ((v - w) / share).ravel()
    places = np.flatnonzero(change)
    yield _row(at=places, change=change[places], sums=sums)


def _total(state: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The change of weights and the sums over the tasks, and how many tasks moved something."""
    told = state.where("sums is not null")
    cells = told.select(F.explode(F.arrays_zip("at", "change")).alias("x")).groupBy(F.col("x.at").alias("i")).agg(F.sum("x.change").alias("x")).toPandas()  # as long as the weights
    change = np.zeros(size)
    change[cells["i"].to_numpy(dtype=int)] = cells["x"].to_numpy(dtype=float)
    row = told.agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(4)], F.count(F.when(F.size("at") > 0, 1)).alias("n")).first()
    return change, np.array([row[f"s{k}"] or 0.0 for k in range(4)]), row["n"]


def fit(
    spark: SparkSession, rows: DataFrame, features: int, loss: str = "hinge", c: float = 1.0, epsilon: float = 0.1, rounds: int = 200, tolerance: float = 1e-3,
    epochs: int = 2, class_weights: dict | None = None, corners: tuple[float, ...] = CORNERS, merge: bool = False,
) -> Linear:
    """1/2 |w|^2 + C sum of losses (y, idx without repeats, val, weight optional) until the gap to the dual is ``tolerance`` of the value.

    fitted.gap is that gap, fitted.rounds the rounds in the dual, fitted.passes all passes over the rows. corners: by how
    much the start rounds the losses off, one fit after the other; none for a start from zero. merge: see linear.merged(), a
    row's limit is C times its weight.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    ship(spark)
    data, classes, outputs = prepared(rows, features, loss, class_weights)
    scratch = Scratch(spark, "dual")
    data = scratch.table(L.merged(data), "merged") if merge else data
    state, name = scratch.table(spread(data).mapInArrow(partial(_packed, outputs=outputs, c=c), STATE), "state"), "state"
    shape = (outputs, features + 1)
    w, step, share, value, gap = np.zeros(shape), 0.0, 1.0, 0.0, np.inf
    done, passes = False, [0]
    if corners:
        smooth, data = _SMOOTH.get(loss, loss), spread(data).cache()
        cornered = loss in ("hinge", "epsilon", "crammer_singer")
        for corner in corners if cornered else corners[-1:]:
            f, at = (make(data, shape, smooth, c, epsilon, corner, passes) for make in (L.objective, L.curvature))
            out = searched_newton(f, at, w.ravel(), 60, tolerance * (1e-2 if corner == corners[-1] else 1e-1))
            w = out.x.reshape(shape)
        data.unpersist()
        state = scratch.table(state.mapInArrow(partial(_started, w=w, loss=loss, epsilon=epsilon, corner=corners[-1]), STATE), "started")
        scratch.drop(name)
        name, passes[0] = "started", passes[0] + 1
        w = _total(state, w.size)[0].reshape(shape)
    for r in range(rounds):
        blocks = state.where("y is not null")
        state, last, name = scratch.table(blocks.mapInArrow(partial(_round, w=w, step=step, share=share, loss=loss, epsilon=epsilon, epochs=epochs, seed=r), STATE), f"state{r}"), name, f"state{r}"
        scratch.drop(last)
        change, (lost, before, after, curve), tasks = _total(state, w.size)
        own = float((w * w).sum())
        value, gap = 0.5 * own + lost, own + lost + before
        if gap <= tolerance * max(abs(value), 1e-300):
            done = True
            break
        along = change.reshape(shape)
        fall = before - after - float((w * along).sum()) + curve / 2
        step = float(np.clip(fall / max(float((along * along).sum()) + curve, 1e-300), 0, 1))
        w = w + step * along
        # tasks that overshoot together allow for one another in the next round
        share = min(max(1.0, tasks), share / max(step, 0.1)) if step < 0.9 else max(1.0, share * 0.8)
    scratch.drop(name, *(["merged"] if merge else []))
    return Linear(w, classes, loss, Result(w.ravel(), float(value), r + 1, bool(done), passes[0] + r + 1, float(gap)))


def one_vs_rest(spark: SparkSession, rows: DataFrame, features: int, **options) -> Linear:
    """Two classes in one fit; of more each against the rest, a row of weights each."""
    most = 20_000_000 // (features + 1)
    classes = sorted(r[0] for r in rows.select("y").distinct().limit(most + 1).collect())
    if len(classes) <= 2:
        return fit(spark, rows, features, **options)
    if len(classes) > most:
        raise ValueError("too many weights for the driver")
    each = [fit(spark, rows.withColumn("y", (F.col("y") == k).cast("int")), features, **options) for k in classes]
    return Linear(np.concatenate([m.weights for m in each]), classes, each[0].loss)


__all__ = ["LOSSES", "REGRESSION", "fit", "one_vs_rest"]
