"""Kernel machines of large groups whose kernel has few directions, by an interior-point method.

Some of the rows (pivots, by pivoted Cholesky decomposition) span all others: every row's kernel values follow
from those with the pivots, and what is left of any row is verified to be under a bound that keeps all gradients
within a tenth of the tolerance. A row is then a short vector, and the dual problem is solved by a primal-dual
method with Mehrotra's correction: some twenty steps, whatever the number of rows or of support vectors. A step
takes three passes over the rows, which give sums of the size of the pivots squared.

Nothing is written between the passes: a row's variables follow from the steps so far, which tasks replay.
Rows that equal each other are one variable with the sum of their limits. The method ends where the duality gap
bounds the distance of every decision value from the best solution's by the tolerance. Problems with too many
pivots, or that don't get there, are left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators.kernel import gram
from corpuloom.session import Scratch

RANK, ROUNDS, CHUNK = 512, 100, 4096
#: Relative to the greatest kernel value of a row with itself, what double precision leaves of rows that pivots span.
_FLOOR = 1e-11


@dataclass
class Model:
    """A problem's pivots, their inverse factor, and the steps so far: (q of the prediction, q, added complementarity, length)."""

    pivots: np.ndarray
    inverse: np.ndarray
    bound: float
    scale: float
    start: np.ndarray | None = None
    steps: list = field(default_factory=list)
    now: np.ndarray | None = None
    offset: float = 0.0
    ratio: float = 1.0

    def vectors(self, x: np.ndarray, kernel: str, options: dict) -> np.ndarray:
        return gram(x, self.pivots, kernel, **options) @ self.inverse.T


def product(kernel: str, options: dict) -> bool:
    """Whether a kernel is an inner product, so that Cholesky decomposition applies."""
    if kernel == "poly":
        degree = options.get("degree", 3)
        return options.get("gamma", 1.0) >= 0 and options.get("coef0", 0.0) >= 0 and degree == int(degree) and degree >= 0
    return kernel == "linear" or kernel == "rbf" and options.get("gamma", 1.0) >= 0


def _self(x: np.ndarray, kernel: str, options: dict) -> np.ndarray:
    """Kernel values of rows with themselves."""
    square = (x * x).sum(1)
    if kernel == "rbf":
        return np.ones(len(x))
    return square if kernel == "linear" else (options.get("gamma", 1.0) * square + options.get("coef0", 0.0)) ** options.get("degree", 3)


def _inverse(pivots: np.ndarray, kernel: str, options: dict) -> np.ndarray:
    return np.linalg.solve(np.linalg.cholesky(gram(pivots, pivots, kernel, **options)), np.eye(len(pivots)))


def _parts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Problem, vectors and columns of at most CHUNK rows of one problem."""
    for batch in batches:
        problem = batch.column("problem").to_numpy()
        for k in np.unique(problem).tolist():
            mine = np.flatnonzero(problem == k)
            for at in range(0, len(mine), CHUNK):
                rows = batch.take(pa.array(mine[at : at + CHUNK]))
                x = rows.column("x")
                yield k, x.flatten().to_numpy().reshape(len(x), -1), [rows.column(n).to_numpy() for n in names]


def more_pivots(x: np.ndarray, pivots: np.ndarray, inverse: np.ndarray, bound: float, most: int, kernel: str, options: dict) -> list[int]:
    """Rows of x that with the pivots leave no row more than the bound, or the first ``most`` of them."""
    lead = gram(x, pivots, kernel, **options) @ inverse.T if len(pivots) else np.zeros((len(x), 0))
    rest = _self(x, kernel, options) - (lead * lead).sum(1)
    columns = np.zeros((len(x), 0))
    found: list[int] = []
    while len(found) < most:
        i = int(np.argmax(rest))
        if rest[i] <= bound:
            break
        if len(found) == columns.shape[1]:
            columns = np.hstack([columns, np.zeros((len(x), 64))])
        n = len(found)
        column = (gram(x, x[i : i + 1], kernel, **options)[:, 0] - lead @ lead[i] - columns[:, :n] @ columns[i, :n]) / np.sqrt(rest[i])
        columns[:, n] = column
        rest = rest - column * column
        rest[i] = 0
        found.append(i)
    return found


def _searched(batches, models: dict, most: int, kernel: str, options: dict):
    """New pivots of a task's rows; one more than there may be where they are too many."""
    held: dict[int, list] = {}
    for k, x, _ in _parts(batches, ()):
        if k not in models:
            continue
        pivots, inverse, bound = held.setdefault(k, [models[k].pivots.reshape(-1, x.shape[1]), models[k].inverse, models[k].bound])
        if len(pivots) > most:
            continue
        new = more_pivots(x, pivots, inverse, bound, most + 1 - len(pivots), kernel, options)
        if new:
            pivots = np.vstack([pivots, x[new]])
            held[k] = [pivots, _inverse(pivots, kernel, options) if len(pivots) <= most else inverse, bound]
    for k, (pivots, _, _) in held.items():
        new = pivots[len(models[k].pivots) :]
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(new), pa.int32()), pa.array(new.tolist(), pa.list_(pa.float64()))], ["problem", "x"])


def _factored(spark: SparkSession, rows: DataFrame, models: dict, most: int, kernel: str, options: dict) -> dict:
    """The models whose rows ``most`` pivots span, with their pivots."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        model, x = models[int(frame["problem"].iloc[0])], np.stack(frame["x"].to_numpy())
        kept = more_pivots(x, model.pivots.reshape(-1, x.shape[1]), model.inverse, model.bound, most + 1 - len(model.pivots), kernel, options)
        return pd.DataFrame({"problem": frame["problem"].to_numpy()[kept], "x": list(x[kept])})

    done, left = {}, dict(models)
    while left:
        models = left
        search = partial(_searched, models=models, most=most, kernel=kernel, options=options)
        found: dict = {}
        for r in rows.mapInArrow(search, "problem int, x array<double>").groupBy("problem").applyInPandas(merge, "problem int, x array<double>").collect():
            found.setdefault(r["problem"], []).append(r["x"])  # most + 1 rows a problem
        done |= {k: m for k, m in left.items() if k not in found}
        left = {}
        for k, x in found.items():
            model = models[k]
            pivots = np.vstack([model.pivots.reshape(-1, len(x[0])), x])
            if len(pivots) <= most:
                left[k] = Model(pivots, _inverse(pivots, kernel, options), model.bound, model.scale)
    return done


def _directions(state: tuple, g: np.ndarray, step: tuple):
    """Changes of a, z and u by the prediction, and by the whole step if it is known."""
    p, a, v, z, u, along = state
    weight, rest = 1 / (z / a + u / v), -(p + along - z + u)
    da = weight * (rest - z + u - g @ step[0])
    dz, du = -z - z * da / a, -u + u * da / v
    if step[1] is None:
        return da, dz, du, None
    rz, ru = step[2] - a * z - da * dz, step[2] - v * u + da * du
    along = g @ step[1]
    da = weight * (rest + rz / a - ru / v - along)
    return da, (rz - z * da) / a, (ru + u * da) / v, along


def _replayed(model: Model, s: np.ndarray, x: np.ndarray, p: np.ndarray, top: np.ndarray, apart: bool, kernel: str, options: dict):
    """The rows' vectors (their sides behind, negative) and state after the model's steps."""
    sides = np.stack([s > 0, s < 0], 1).astype(float) if apart else s[:, None]
    g = np.hstack([s[:, None] * model.vectors(x, kernel, options), -sides])
    a, one = top / 2, np.full(len(s), model.scale)
    state = (p, a, a.copy(), one, one.copy(), g @ model.start)
    for step in model.steps:
        da, dz, du, along = _directions(state, g, step)
        _, a, v, z, u, was = state
        t = step[3]
        state = (p, *(np.maximum(x, 1e-300) for x in (a + t * da, v - t * da, z + t * dz, u + t * du)), was + t * along)
    return g, state


def _longest(state: tuple, da: np.ndarray, dz: np.ndarray, du: np.ndarray) -> float:
    """How far a step may go before a variable meets zero."""
    _, a, v, z, u, _ = state
    longest = np.inf
    for value, change in ((a, da), (v, -da), (z, dz), (u, du)):
        down = change < 0
        if down.any():
            longest = min(longest, float((-value[down] / change[down]).min()))
    return longest


_SUMS = "problem int, least double, most double, sums array<double>"


def _passed(batches, kind: str, models: dict, step: dict, apart: bool, kernel: str, options: dict):
    """Sums over a task's rows: of the system and its right side, of the prediction, the step's length, or the offset."""
    told: dict[int, list] = {}
    for k, x, (s, p, top) in _parts(batches, ("s", "p", "top")):
        if k not in models:
            continue
        g, state = _replayed(models[k], s, x, p, top, apart, kernel, options)
        _, a, v, z, u, along = state
        least, most, sums = np.inf, -np.inf, np.zeros(0)
        if kind == "system":
            weight = 1 / (z / a + u / v)
            rest = -(p + along - z + u)
            scaled = g * weight[:, None]
            sums = np.concatenate([(g.T @ scaled).ravel(), scaled.T @ (rest - z + u), g.T @ a, [a @ z + v @ u, len(a)]])
            most = float(np.abs(rest).max())
        elif kind == "predicted":
            da, dz, du, _ = _directions(state, g, (*step[k][:1], None))
            weight = 1 / (z / a + u / v)
            rest = -(p + along - z + u)
            least = _longest(state, da, dz, du)
            sums = np.concatenate([g.T @ (weight * (rest - z + u - da * dz / a - da * du / v)), g.T @ (weight * (1 / a - 1 / v)), [a @ dz + z @ da + v @ du - u @ da, da @ dz - da @ du]])
        elif kind == "length":
            least = _longest(state, *_directions(state, g, step[k])[:3])
        else:  # levels of each side: of free rows sum and number, the least of those that may go up, the greatest of those that may go down
            size = g.shape[1] - (2 if apart else 1)
            gradient = p + g[:, :size] @ models[k].now[:size]
            for side in (1, -1) if apart else (0,):
                level = gradient if apart else s * gradient
                held = s == side if apart else np.ones(len(s), bool)
                more, less = v > 1e-6 * top, a > 1e-6 * top
                way = s > 0 if not apart else np.full(len(s), side > 0)
                up, down, free = np.where(way, more, less) & held, np.where(way, less, more) & held, more & less & held
                key = (k, side)
                was = told.get(key, [np.inf, -np.inf, np.zeros(2)])
                told[key] = [min(was[0], level[up].min(initial=np.inf)), max(was[1], level[down].max(initial=-np.inf)), was[2] + [level[free].sum(), free.sum()]]
            continue
        was = told.get((k, 0), [np.inf, -np.inf, 0.0])
        told[k, 0] = [min(was[0], least), max(was[1], most), was[2] + sums]
    for (k, side), (least, most, sums) in told.items():
        sums = np.append(sums, side) if kind == "offset" else sums
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([least]), pa.array([most]), pa.array([sums], pa.list_(pa.float64()))], ["problem", "least", "most", "sums"])


def fit(spark: SparkSession, variables: DataFrame, apart: bool, kernel: str, options: dict, tolerance: float, most: int = RANK, rounds: int = ROUNDS) -> dict:
    """Models of the problems that the method solves. variables: problem, s, x, p, top, a, as the decomposition starts; a is feasible."""
    scratch = Scratch(spark, "interior")
    own = variables.where("top > 0")
    norm = F.aggregate("x", F.lit(0.0), lambda t, e: t + e * e)
    facts = own.groupBy("problem").agg(
        F.sum("top").alias("top"), F.sum(F.when(F.col("s") > 0, F.col("a")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("s") < 0, F.col("a")).otherwise(0.0)).alias("minus"),
        F.max(norm).alias("norm"), F.max(F.abs("p")).alias("p"), F.max((F.size("x") == 0).cast("int")).alias("bare"),
    ).collect()  # a row per problem
    models, totals, reach = {}, {}, {}
    for r in facts:
        if not np.isfinite([r["top"], r["norm"] if r["norm"] is not None else np.nan, r["p"]]).all() or r["bare"]:
            continue
        k, greatest = r["problem"], float(_self(np.array([[np.sqrt(r["norm"])]]), kernel, options)[0])
        bound = tolerance / (10 * r["top"])
        if not greatest > 0 or bound < _FLOOR * greatest:
            continue
        models[k] = Model(np.zeros((0, 0)), np.zeros((0, 0)), min(bound, 1e-9 * greatest), max(1.0, r["p"]))
        totals[k] = np.array([r["plus"], r["minus"]] if apart else [r["plus"] - r["minus"]])
        reach[k] = tolerance**2 / 2 / max(greatest, 1.0)
    if not models:
        return {}
    rows = own.groupBy("problem", "s", "x", "p").agg(F.sum("top").alias("top"))
    # few tasks, each of few problems: a pass gives a system for each of a task's problems
    rows = scratch.table(rows.repartitionByRange(spark.sparkContext.defaultParallelism, "problem", F.xxhash64("x", "s", "p")), "rows")
    models = _factored(spark, rows, models, most, kernel, options)
    sides = 2 if apart else 1

    def sums(kind: str, live: dict, step: dict | None = None) -> dict:
        run = partial(_passed, kind=kind, models=live, step=step or {}, apart=apart, kernel=kernel, options=options)
        out: dict = {}
        for r in rows.where(F.col("problem").isin(list(live))).mapInArrow(run, _SUMS).collect():  # a row per task, and one more per problem
            value = np.array(r["sums"])
            key = (r["problem"], value[-1]) if kind == "offset" else r["problem"]
            was = out.get(key, (np.inf, -np.inf, 0.0))
            out[key] = (min(was[0], r["least"]), max(was[1], r["most"]), was[2] + value)
        return out

    for m in models.values():
        m.start = np.zeros(len(m.pivots) + sides)
    for k, (_, _, value) in (sums("system", models) if models else {}).items():
        n = len(models[k].start)
        models[k].start = np.append(value[n * n + n : n * n + 2 * n - sides], np.zeros(sides))
        models[k].now = models[k].start.copy()
    done: dict = {}
    live = dict(models)
    for _ in range(rounds):
        if not live:
            break
        systems, step = {}, {}
        for k, (_, worst, value) in sums("system", live).items():
            m = live[k]
            n = len(m.now)
            size, at = n - sides, n * n + n
            moved, (gap, count) = value[at : at + n], value[-2:]
            left = np.append(m.now[:size] - moved[:size], -(totals[k] + moved[size:]))
            missed = np.abs(left).max() / max(1.0, np.abs(totals[k]).max(), np.abs(m.now[:size]).max(initial=0))
            if gap <= reach[k] and worst <= tolerance / 10 and missed <= 1e-7:
                done[k] = live.pop(k)
                continue
            try:
                matrix = value[: n * n].reshape(n, n).copy()
                matrix[np.arange(size), np.arange(size)] += 1
                low = np.linalg.cholesky(matrix)
            except np.linalg.LinAlgError:
                del live[k]
                continue
            solve = lambda b, low=low, left=left: np.linalg.solve(low.T, np.linalg.solve(low, b - left))
            systems[k] = (solve, gap, count)
            step[k] = (solve(value[n * n : at]), None)
        if not live:
            break
        for k, (least, _, value) in sums("predicted", live, step).items():
            solve, gap, count = systems[k]
            t, n = min(1.0, least), len(live[k].now)
            ahead = max(gap + t * value[-2] + t * t * value[-1], 0.0)
            added = (ahead / gap) ** 3 * gap / (2 * count)
            step[k] = (step[k][0], solve(value[:n] + added * value[n : 2 * n]), added)
        for k, (least, _, _) in sums("length", live, step).items():
            t = min(1.0, 0.995 * least)
            if not t > 1e-8 or not np.isfinite(step[k][1]).all():
                del live[k]
                continue
            live[k].steps.append((*step[k], t))
            live[k].now = live[k].now + t * step[k][1]
    level: dict = {}
    for (k, side), (least, most_, value) in (sums("offset", done) if done else {}).items():
        bound = [x for x in (least, most_) if np.isfinite(x)]
        level[k, side] = value[0] / value[1] if value[1] else sum(bound) / 2 if len(bound) == 2 else 0.0
    for k, m in done.items():
        if apart:
            plus, minus = level.get((k, 1), 0.0), level.get((k, -1), 0.0)
            m.offset, m.ratio = (plus - minus) / 2, (plus + minus) / 2
        else:
            m.offset = level[k, 0]
    scratch.drop("rows")
    return done


def _valued(batches, models: dict, kernel: str, options: dict):
    for k, x, (row,) in _parts(batches, ("row",)):
        m = models[k]
        z = (m.vectors(x, kernel, options) @ m.now[: len(m.pivots)] - m.offset) / m.ratio
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int32()), pa.array(row, pa.int64()), pa.array(z)], ["problem", "row", "z"])


def values(problems: DataFrame, models: dict, kernel: str, options: dict) -> DataFrame:
    """problem, row, z of rows (problem, row, x), those to predict too."""
    rows = problems.select(F.col("problem").cast("int").alias("problem"), F.col("row").cast("long").alias("row"), F.col("x").cast("array<double>").alias("x"))
    small = {k: Model(m.pivots, m.inverse, m.bound, m.scale, now=m.now, offset=m.offset, ratio=m.ratio) for k, m in models.items()}
    return rows.mapInArrow(partial(_valued, models=small, kernel=kernel, options=options), "problem int, row long, z double")
