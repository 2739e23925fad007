"""Kernel machines of groups that are too large for one task, exactly.

The dual problem of a kernel machine is solved by decomposition: in each round the variables that violate
optimality most make a working set, whose small problem one task solves by sequential minimal optimization,
and every row then adds the change's kernel values to its own gradient. Rows and gradients stay distributed,
in a state table that each round writes anew; a round moves one working set. A machine ends where no pair of
variables violates optimality by more than the tolerance, which is also where the solver of one task ends.
Decomposition is for kernels whose rows have many directions, and for those that are no inner products: its
rounds grow with the support vectors. Others go to operators/interior_kernel.py, whose rounds don't.

Rows to predict are variables that may not move: they too add up kernel values, so their decision values are
there when the fit ends, and support vectors never need to be gathered or sent. More than two classes make a
machine per pair of classes, which vote. Machines are fitted side by side, ``WAVE`` at a time, so what a round
sends (working sets and their vectors) has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.operators import interior_kernel
from corpuloom.operators.kernel import KERNELS, TYPES, gram, smo
from corpuloom.session import Scratch, ship, spread

WAVE, WORKING, START = 32, 512, 4096
STATE = "problem int, vid long, row long, s double, x array<double>, p double, top double, a double, g double, up boolean, down boolean"
_ARROW = pa.schema([
    ("problem", pa.int32()), ("vid", pa.int64()), ("row", pa.int64()), ("s", pa.float64()), ("x", pa.list_(pa.float64())), ("p", pa.float64()),
    ("top", pa.float64()), ("a", pa.float64()), ("g", pa.float64()), ("up", pa.bool_()), ("down", pa.bool_()),
])


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _movable(s: np.ndarray, a: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which variables can move up and down along their sign."""
    more, less = (top > 0) & (a < top - 1e-12), (top > 0) & (a > 1e-12)
    return np.where(s > 0, more, less), np.where(s > 0, less, more)


def _advanced(batches: Iterator[pa.RecordBatch], changes: dict, kernel: str, options: dict, working: int, apart: bool):
    """Rows after a change of some variables, the worst violators of each batch marked."""
    for batch in batches:
        get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        problem, vid, s, top = get("problem"), get("vid"), get("s"), get("top")
        a, g = get("a").copy(), get("g").copy()
        up, down = np.zeros(len(a), bool), np.zeros(len(a), bool)
        for k in np.unique(problem).tolist():
            mine = np.flatnonzero(problem == k)
            if k in changes:
                vids, vectors, signed, plain = changes[k]
                g[mine] += s[mine] * (gram(_vectors(batch.column("x").take(pa.array(mine))), vectors, kernel, **options) @ signed)
                at = np.minimum(np.searchsorted(vids, vid[mine]), len(vids) - 1)
                a[mine] += np.where(vids[at] == vid[mine], plain[at], 0)
                a[mine] = np.clip(a[mine], 0, top[mine])
            score = -s[mine] * g[mine]
            for side in (1, -1) if apart else (0,):
                held = np.ones(len(mine), bool) if side == 0 else s[mine] == side
                can_up, can_down = _movable(s[mine], a[mine], top[mine])
                for can, order, mark in ((can_up, -score, up), (can_down, score, down)):
                    here = np.flatnonzero(can & held)
                    mark[mine[here[np.argsort(order[here], kind="stable")[:working]]]] = True
        columns = {**{n: batch.column(n) for n in ("problem", "vid", "row", "s", "x", "p", "top")}, "a": pa.array(a), "g": pa.array(g), "up": pa.array(up), "down": pa.array(down)}
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)


_CHANGE = "problem int, gap double, vid long, x array<double>, signed double, plain double"


def _solved(frame: pd.DataFrame, kernel: str, options: dict, apart: bool, tolerance: float) -> pd.DataFrame:
    """The changes of one working set, and by how much its worst pair violated optimality before."""
    frame = frame.sort_values("vid")
    s, a, g, top = (frame[n].to_numpy(float) for n in ("s", "a", "g", "top"))
    up, down = _movable(s, a, top)
    score, gap = -s * g, -np.inf
    for side in (1, -1) if apart else (0,):
        held = np.ones(len(s), bool) if side == 0 else s == side
        if (up & held).any() and (down & held).any():
            gap = max(gap, float(score[up & held].max() - score[down & held].min()))
    kept = np.zeros(len(s), bool)
    change = np.zeros(len(s))
    x = np.stack(frame["x"].to_numpy())
    if gap >= tolerance:
        q = gram(x, x, kernel, **options) * s[:, None] * s[None, :]
        new, _ = smo(q, g - q @ a, s, top, a, apart, tolerance / 2, 20_000)
        change = new - a
        kept = change != 0
    first = pd.DataFrame({"problem": frame["problem"].iloc[:1], "gap": [gap], "vid": [-1], "x": [x[0]], "signed": [0.0], "plain": [0.0]})
    moves = pd.DataFrame({"problem": frame["problem"].to_numpy()[kept], "gap": gap, "vid": frame["vid"].to_numpy()[kept], "x": list(x[kept]), "signed": (s * change)[kept], "plain": change[kept]})
    return pd.concat([first, moves]) if len(moves) else first


def _sets(state: DataFrame, working: int, apart: bool) -> DataFrame:
    """The working set of each problem: the worst that can move up, and down (of each sign, with ``apart``). Ranked without their vectors."""
    score = -F.col("s") * F.col("g")
    side = F.col("s") if apart else F.lit(0.0)
    way = lambda can, by: state.where(can).select("problem", "vid", side.alias("side"), F.lit(can).alias("way"), by.alias("order"))
    both = way("up", -score).unionByName(way("down", score))
    rank = F.row_number().over(Window.partitionBy("problem", "side", "way").orderBy("order", "vid"))
    chosen = both.withColumn("rank", rank).where(F.col("rank") <= (working // 4 if apart else working // 2)).select(F.col("vid").alias("_vid")).distinct()
    return state.where("up or down").join(F.broadcast(chosen), F.col("vid") == F.col("_vid"), "left_semi")  # working x WAVE at most


def _started(problems: DataFrame, kind: str, c: float, nu: float, epsilon: float, class_weights: dict | None) -> DataFrame:
    """Rows with their problems as variables, at a feasible start. problems: problem, row, y, x, pos, neg, n_pos, n_neg."""
    known = F.col("y").isNotNull()
    zero = F.lit(0.0)
    if kind in ("epsilon_svr", "nu_svr"):
        edge = epsilon if kind == "epsilon_svr" else 0.0
        begin = 0.0 if kind == "epsilon_svr" else c * nu / 2
        one = lambda sign: F.struct(F.lit(sign).alias("s"), (F.lit(edge) - sign * F.col("y")).alias("p"), F.lit(float(c)).alias("top"), F.lit(begin).alias("a"))
        idle = F.struct(F.lit(1.0).alias("s"), zero.alias("p"), zero.alias("top"), zero.alias("a"))
        each = F.when(known, F.array(one(1.0), one(-1.0))).otherwise(F.array(idle))
        return problems.select("problem", "row", "x", F.explode(each).alias("v")).select("problem", "row", "x", "v.*")
    if kind == "one_class":
        return problems.select("problem", "row", "x", F.lit(1.0).alias("s"), zero.alias("p"), F.when(known, 1.0).otherwise(0.0).alias("top"), F.when(known, float(nu)).otherwise(0.0).alias("a"))
    plus, minus = F.coalesce(F.col("y") == F.col("pos"), F.lit(False)), F.coalesce(F.col("y") == F.col("neg"), F.lit(False))
    sign = F.when(minus, -1.0).otherwise(1.0)
    if kind == "c_svc":
        weight = F.coalesce(*[F.when(F.col("y") == k, F.lit(float(w))) for k, w in (class_weights or {}).items()], F.lit(1.0))
        return problems.select("problem", "row", "x", sign.alias("s"), F.lit(-1.0).alias("p"), F.when(plus | minus, c * weight).otherwise(0.0).alias("top"), zero.alias("a"))
    share = nu * (F.col("n_pos") + F.col("n_neg")) / 2
    begin = F.when(plus, share / F.col("n_pos")).when(minus, share / F.col("n_neg")).otherwise(0.0)
    return problems.select("problem", "row", "x", sign.alias("s"), zero.alias("p"), F.when(plus | minus, 1.0).otherwise(0.0).alias("top"), begin.alias("a"))


def _offsets(state: DataFrame, apart: bool) -> dict:
    """For each problem the offset of its decisions and their scale, from the variables off their limits, or else from the bounds."""
    s = F.lit(1.0) if apart else F.col("s")
    level = s * F.col("g")
    more, less = F.col("a") < F.col("top") - 1e-9, F.col("a") > 1e-9
    up, down = F.when(s > 0, more).otherwise(less), F.when(s > 0, less).otherwise(more)
    keys = ["problem", "s"] if apart else ["problem"]
    told = state.where("top > 0").groupBy(*keys).agg(F.avg(F.when(more & less, level)).alias("free"), F.max(F.when(down, level)).alias("hi"), F.min(F.when(up, level)).alias("lo")).collect()
    out: dict = {}
    for r in told:  # one or two rows a problem
        bound = [x for x in (r["hi"], r["lo"]) if x is not None]
        value = r["free"] if r["free"] is not None else sum(bound) / 2 if len(bound) == 2 else 0.0
        out.setdefault(r["problem"], {})[r["s"] if apart else 0] = value
    if not apart:
        return {k: (v[0], 1.0) for k, v in out.items()}
    return {k: ((v.get(1.0, 0.0) - v.get(-1.0, 0.0)) / 2, (v.get(1.0, 0.0) + v.get(-1.0, 0.0)) / 2) for k, v in out.items()}


def decisions(
    spark: SparkSession, problems: DataFrame, kind: str = "c_svc", kernel: str = "rbf", c: float = 1.0, nu: float = 0.5, epsilon: float = 0.1, tolerance: float = 1e-3,
    working: int = WORKING, rounds: int = 10_000, class_weights: dict | None = None, rank: int = interior_kernel.RANK, **options,
) -> DataFrame:
    """problem, row, z of machines fitted side by side: rows (problem, row, y, x, pos, neg, n_pos, n_neg), y null or of no class where to predict only.

    Kernels that ``rank`` rows span are solved by interior points, the rest by decomposition."""
    if kind not in TYPES or kernel not in KERNELS or kernel == "precomputed":
        raise ValueError(f"kind must be one of {TYPES}, kernel one of {KERNELS} but precomputed")
    ship(spark)
    apart = kind in ("nu_svc", "nu_svr")
    scratch = Scratch(spark, "kernel")
    begun = _started(problems, kind, c, nu, epsilon, class_weights)
    if rank and interior_kernel.product(kernel, options):
        solved = interior_kernel.fit(spark, begun, apart, kernel, options, tolerance, rank)
        if solved:
            for m in solved.values():
                m.ratio = m.ratio if kind == "nu_svc" and abs(m.ratio) > 1e-12 else 1.0
            here = F.col("problem").isin(list(solved))
            z = interior_kernel.values(problems.where(here), solved, kernel, options)
            rest = problems.where(~here)
            if rest.isEmpty():
                return z
            return z.unionByName(decisions(spark, rest, kind, kernel, c, nu, epsilon, tolerance, working, rounds, class_weights, 0, **options))
    begun = begun.withColumns({"vid": F.monotonically_increasing_id(), "g": F.col("p"), "up": F.lit(False), "down": F.lit(False)})
    names = [f.name for f in _ARROW]
    state, name = scratch.table(spread(begun).select(*[F.col(n).cast(t) for n, t in zip(names, ("int", "long", "long", "double", "array<double>", "double", "double", "double", "double", "boolean", "boolean"))]), "state"), "state"
    count = 0

    def advance(changes: dict) -> None:
        nonlocal state, name, count
        count += 1
        run = partial(_advanced, changes=changes, kernel=kernel, options=options, working=working, apart=apart)
        last, name = name, f"state{count}"
        state = scratch.table(state.mapInArrow(run, STATE), name)
        scratch.drop(last)

    def told(rows: list) -> dict:
        out: dict = {}
        for r in sorted(rows, key=lambda r: (r["problem"], r["vid"])):
            out.setdefault(r["problem"], []).append(r)
        return {k: (np.array([r["vid"] for r in v]), np.array([r["x"] for r in v]), np.array([r["signed"] for r in v]), np.array([r["plain"] for r in v])) for k, v in out.items()}

    if kind in ("one_class", "nu_svc"):  # the start's own kernel values, START rows of all problems at a time; those of nu_svr cancel out
        moving = scratch.table(state.where("a > 0").withColumn("_at", F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("vid"))).select("problem", "vid", "x", "s", "a", (F.col("_at") / START).cast("int").alias("_wave"), F.spark_partition_id().alias("_part")), "moving")
        for w in sorted(tuple(r) for r in moving.select("_part", "_wave").distinct().collect()):  # a row per START rows
            rows = [{"problem": r["problem"], "vid": r["vid"], "x": r["x"], "signed": r["s"] * r["a"], "plain": 0.0} for r in moving.where((F.col("_part") == w[0]) & (F.col("_wave") == w[1])).collect()]
            advance(told(rows))
    else:
        advance({})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return _solved(frame, kernel, options, apart, tolerance)

    for _ in range(rounds):
        solved = _sets(state, working, apart).groupBy("problem").applyInPandas(solve, _CHANGE)
        moves = [r.asDict() for r in solved.collect()]  # working x WAVE rows at most
        changes = told([r for r in moves if r["vid"] >= 0])
        if not changes:
            break
        advance(changes)
    found = _offsets(state, apart)
    known = spark.createDataFrame([(int(k), float(o), float(q) if kind == "nu_svc" and abs(q) > 1e-12 else 1.0) for k, (o, q) in found.items()] or [(-1, 0.0, 1.0)], "_p int, _offset double, _scale double")
    own = state.where("s > 0 or top = 0" if kind.endswith("svr") else "true")
    z = (F.col("s") * (F.col("g") - F.col("p")) - F.col("_offset")) / F.col("_scale")
    return own.join(F.broadcast(known), F.col("problem") == F.col("_p")).select("problem", "row", z.alias("z"))


def by_group(spark: SparkSession, rows: DataFrame, group: str, values: list, wave: int = WAVE, **options) -> DataFrame:
    """group, id, pred of the named (large) groups of rows (group, id, y, x; y null where to predict)."""
    kind = options.get("kind", "c_svc")
    out = None
    scratch = Scratch(spark, "large")
    index = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_g int, _value {rows.schema[group].dataType.simpleString()}")
    held = rows.join(F.broadcast(index), F.col(group).eqNullSafe(F.col("_value"))).select("_g", group, F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x"))
    held = scratch.table(held.withColumn("row", F.monotonically_increasing_id()), "rows")
    machines: list[tuple] = []  # problem, group, classes and their places, sizes
    alone = []
    if kind in ("c_svc", "nu_svc"):
        sizes: dict = {}
        for r in held.where("y is not null").groupBy("_g", "y").count().collect():  # a row per class
            sizes.setdefault(r["_g"], {})[r["y"]] = r["count"]
        for g, found in sorted(sizes.items()):
            classes = sorted(found, reverse=True)
            if len(classes) == 1:
                alone.append((g, classes[0]))
            pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
            machines += [(len(machines) + k, g, classes[i], classes[j], found[classes[i]], found[classes[j]], i, j) for k, (i, j) in enumerate(pairs)]
    else:
        machines = [(r["_g"], r["_g"], 0.0, 0.0, 0, 0, 0, 0) for r in held.where("y is not null").select("_g").distinct().collect()]
    fitted = {m[1] for m in machines} | {g for g, _ in alone}
    alone += [(g, None) for g in range(len(values)) if g not in fitted]  # without a label, as in one task
    for at in range(0, len(machines), wave):
        table = spark.createDataFrame(machines[at : at + wave], "problem int, _of int, pos double, neg double, n_pos long, n_neg long, i int, j int")
        each = held.join(F.broadcast(table), F.col("_g") == F.col("_of"))
        z = decisions(spark, each.select("problem", "row", "y", "x", "pos", "neg", "n_pos", "n_neg"), **options)
        z = z.join(F.broadcast(table.withColumnRenamed("problem", "_p")), F.col("problem") == F.col("_p")).select("row", "z", "pos", "neg", "i", "j")
        out = z if out is None else out.unionByName(z)
    parts = []
    if out is not None:
        if kind in ("c_svc", "nu_svc"):
            won = out.select("row", F.when(F.col("z") > 0, F.col("pos")).otherwise(F.col("neg")).alias("pred"), F.when(F.col("z") > 0, F.col("i")).otherwise(F.col("j")).alias("place"))
            votes = won.groupBy("row", "pred", "place").agg(F.count(F.lit(1)).alias("n"))
            chosen = votes.groupBy(F.col("row").alias("_row")).agg(F.max_by("pred", F.struct("n", -F.col("place"))).alias("pred"))
        elif kind == "one_class":
            chosen = out.select(F.col("row").alias("_row"), F.when(F.col("z") > 0, 1.0).otherwise(-1.0).alias("pred"))
        else:
            chosen = out.select(F.col("row").alias("_row"), F.col("z").alias("pred"))
        parts.append(held.join(chosen, F.col("row") == F.col("_row")).select(group, "id", "pred"))
    if alone:
        one = spark.createDataFrame(alone, "_of int, pred double")
        parts.append(held.join(F.broadcast(one), F.col("_g") == F.col("_of")).select(group, "id", "pred"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
