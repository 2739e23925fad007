"""Solvers of linear and kernel machines against each other, against optimality conditions and against one-task versions."""

import numpy as np
import pyarrow as pa
import pytest

from corpuloom.operators import crossfeatures, dual, kernel, large_kernel, linear, optimize, sparse_linear


def _data(n, features, cells, classes=2, number=False, seed=0):
    rng = np.random.default_rng(seed)
    w, rows = rng.normal(size=(classes, features)), []
    for _ in range(n):
        i = np.sort(rng.choice(features, int(rng.integers(0, cells + 1)), replace=False))
        v = rng.normal(size=len(i))
        z = w[:, i] @ v + rng.normal(size=classes)
        rows.append((float(z[0]) if number else float(z.argmax()), i.tolist(), v.tolist(), float(rng.integers(1, 3))))
    return rows


SCHEMA = "y double, idx array<int>, val array<double>, weight double"


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(_data(300, 12, 5), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(_data(200, 8, 4, 3, seed=1), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(_data(250, 9, 4, 1, True, seed=2), SCHEMA).repartition(3).cache()


def _quadratic(n, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n))
    h, b = a @ a.T + 0.1 * np.eye(n), rng.normal(size=n)
    return h, b, lambda x: (float(0.5 * x @ h @ x + b @ x), h @ x + b)


def test_truncated_newton():
    h, b, _ = _quadratic(8)
    ones = np.ones(8)
    s, hs, edge = optimize.truncated_newton(b, lambda v: h @ v, ones, 1e9, 1e-12)
    assert not edge and s == pytest.approx(-np.linalg.solve(h, b)) and hs == pytest.approx(h @ s)
    s, hs, edge = optimize.truncated_newton(b, lambda v: h @ v, np.arange(1.0, 9), 0.01, 1e-12)
    assert edge and np.sqrt(s @ (np.arange(1.0, 9) * s)) == pytest.approx(0.01) and hs == pytest.approx(h @ s)
    s, _, edge = optimize.truncated_newton(b, lambda v: -v, ones, 2.0, 1e-12)  # no positive curvature: down to the boundary
    assert edge and np.linalg.norm(s) == pytest.approx(2.0)


@pytest.mark.parametrize("solver", [optimize.trust_region, optimize.searched_newton])
def test_newton_steps(solver):
    h, b, f = _quadratic(8)
    out = solver(f, lambda x: (lambda v: h @ v, np.diag(h)), np.zeros(8), tolerance=1e-9)
    assert out.converged and out.x == pytest.approx(-np.linalg.solve(h, b))
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)) * [1, 10, 0.1, 3, 1], rng.choice([-1.0, 1.0], 200)

    def logistic(w):
        m = y * (x @ w)
        return float(0.5 * w @ w + np.logaddexp(0, -m).sum()), w - x.T @ (y / (1 + np.exp(m)))

    def curvature(w):
        p = 1 / (1 + np.exp(-x @ w))
        full = np.eye(5) + (x * (p * (1 - p))[:, None]).T @ x
        return lambda v: full @ v, np.diag(full)

    out = solver(logistic, curvature, np.full(5, 3.0), tolerance=1e-10)
    assert out.converged and out.rounds < 25 and np.linalg.norm(logistic(out.x)[1]) < 1e-8


@pytest.mark.parametrize("loss", linear.CURVED)
@pytest.mark.parametrize("direct", [512, 0])
def test_newton_fits(two, three, numbers, spark, loss, direct, monkeypatch):
    """The optimum of L-BFGS, by the whole Hessian and by its products."""
    monkeypatch.setattr(linear, "DIRECT", direct)
    rows, n = {"multinomial": (three, 8), "squared_epsilon": (numbers, 9)}.get(loss, (two, 12))
    data, classes, outputs = linear.prepared(rows, n, loss)
    shape = (outputs, n + 1)
    batch = data.toArrow().combine_chunks().to_batches()[0]

    def sums(parts, size):
        got = parts.to_pandas()
        out = np.zeros(size)
        out[got["i"][got["i"] >= 0]] = got["x"][got["i"] >= 0]
        return out, float(got["x"][got["i"] < 0].sum())

    def f(w):
        g, value = sums(next(linear._gradient([batch], w.reshape(shape), loss, 0.1)), w.size)
        return 0.5 * float(w @ w) + 0.5 * value, w + 0.5 * g

    model = linear.fit(spark, rows, n, loss, c=0.5, solver="newton", tolerance=1e-8)
    best = optimize.lbfgs(f, np.zeros(outputs * (n + 1)), rounds=500, tolerance=1e-8)
    assert model.fitted.converged and model.weights.ravel() == pytest.approx(best.x, abs=1e-6)
    assert model.fitted.passes <= (30 if direct else 150)
    w, v = model.weights * 0.7, np.random.default_rng(0).normal(size=shape)
    product = sums(next(linear._curved([batch], w, v, loss, 0.1)), w.size)[0]
    e = 1e-6
    slope = lambda x: sums(next(linear._gradient([batch], x, loss, 0.1)), w.size)[0]
    if loss in ("logistic", "multinomial"):
        assert product == pytest.approx((slope(w + e * v) - slope(w - e * v)) / (2 * e), rel=1e-4, abs=1e-4)
    upper = np.zeros((w.size, w.size))
    upper[np.triu_indices(w.size)] = sums(next(linear._hessian([batch], w, loss, 0.1, 0.01)), w.size * (w.size + 1) // 2)[0]
    full = upper + np.triu(upper, 1).T
    assert full @ v.ravel() == pytest.approx(product) and np.diag(full) == pytest.approx(sums(next(linear._curved([batch], w, None, loss, 0.1)), w.size)[0])


def test_newton_options(spark, two):
    for wrong in ({"loss": "hinge", "solver": "newton"}, {"solver": "newton", "l1": True}, {"solver": "simplex"}):
        with pytest.raises(ValueError):
            linear.fit(spark, two, 12, **wrong)


@pytest.mark.parametrize("loss", dual.LOSSES)
def test_dual_gap(spark, two, three, numbers, loss):
    """The gap is what it is said to be, by the primal value of the weights, and closed to a thousandth."""
    rows, n = {"crammer_singer": (three, 8), "epsilon": (numbers, 9), "squared_epsilon": (numbers, 9)}.get(loss, (two, 12))
    model = dual.fit(spark, rows, n, loss, c=0.3)
    assert model.fitted.converged and -1e-9 <= model.fitted.gap <= 1e-3 * model.fitted.value
    data = linear.prepared(rows, n, loss)[0].toArrow().combine_chunks().to_batches()[0]
    got = linear.Sparse(data)
    value = 0.5 * float((model.weights**2).sum()) + dual.losses(loss, got.margins(model.weights), got.y, 0.3 * got.weight, 0.1)
    assert model.fitted.value == pytest.approx(value)
    rng = np.random.default_rng(0)
    for _ in range(50):  # nothing near is better than the gap allows
        w = model.weights + rng.normal(size=model.weights.shape) * 10.0 ** rng.uniform(-4, 0)
        other = 0.5 * float((w * w).sum()) + dual.losses(loss, got.margins(w), got.y, 0.3 * got.weight, 0.1)
        assert other >= value - model.fitted.gap - 1e-9


def test_dual_rounds(spark, two):
    """From zero the rounds alone get there, the dual value never falling."""
    model = dual.fit(spark, two.limit(60).repartition(2), 12, "hinge", c=0.02, tolerance=0.02, corners=(), rounds=40)
    assert model.fitted.converged and model.fitted.passes == model.fitted.rounds > 1


def _blocks(rows, outputs, parts, c):
    columns = list(zip(*rows))
    kinds = [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()]
    make = lambda k: pa.RecordBatch.from_arrays([pa.array(x[k::parts], t) for x, t in zip(columns, kinds)], ["y", "idx", "val", "weight"])
    return [list(dual._packed([make(k)], outputs, c)) for k in range(parts)]


@pytest.mark.parametrize("loss", ["hinge", "squared_hinge", "logistic", "epsilon"])
def test_dual_values_never_fall(loss):
    rows = _data(120, 10, 4, 1 if loss == "epsilon" else 2, loss == "epsilon", seed=5)
    rows = rows if loss == "epsilon" else [(2 * y - 1, *rest) for y, *rest in rows]
    parts, w, step, values = _blocks(rows, 1, 4, 0.5), np.zeros((1, 11)), 0.0, []
    for r in range(12):
        out = [list(dual._round(iter(p), w, step, 1.0, loss, 0.1, 2, r)) for p in parts]
        parts, change, sums = [o[:-1] for o in out], np.zeros(11), np.zeros(4)
        for o in out:
            change[o[-1].column("at")[0].values.to_numpy()] += o[-1].column("change")[0].values.to_numpy()
            sums += o[-1].column("sums")[0].values.to_numpy()
        values.append(-0.5 * float((w * w).sum()) - sums[1])
        made = sum(float(d) for p in parts for b in p for d in b.column("dual")[0].values.to_numpy())
        assert made == pytest.approx(float(w[0, -1]), abs=1e-9)  # the bias is the sum of the dual values
        fall = sums[1] - sums[2] - float(w[0] @ change) + sums[3] / 2
        step = float(np.clip(fall / max(float(change @ change) + sums[3], 1e-300), 0, 1))
        w = w + step * change
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and values[-1] > values[0]


def test_dual_moves():
    rng = np.random.default_rng(8)
    for _ in range(300):
        k, q, limit = int(rng.integers(2, 6)), float(rng.uniform(0.1, 5)), float(rng.uniform(0.01, 3))
        z, own = rng.normal(size=k) * 2, int(rng.integers(0, k))
        old = np.zeros(k)
        new = dual.class_moved(z, own, old, q, limit)
        top = np.where(np.arange(k) == own, limit, 0.0)
        assert new.sum() == pytest.approx(0, abs=1e-9) and (new <= top + 1e-12).all()
        value = lambda d: 0.5 * q * d @ d + (z + 1 - (np.arange(k) == own)) @ d
        for _ in range(20):  # feasible others are no better
            other = np.minimum(top, new + rng.normal(size=k) * 0.1)
            other[(own + 1) % k] -= other.sum()
            if (other <= top + 1e-12).all():
                assert value(other) >= value(new) - 1e-9
        alpha, slope = float(rng.uniform(0, limit)), float(rng.normal() * 3)
        x = dual.log_moved(alpha, slope, q, limit)
        assert 0 < x < limit and abs(q * (x - alpha) + slope + np.log(x / (limit - x))) < 1e-6


@pytest.mark.parametrize("loss", sparse_linear.LOSSES)
def test_sparse_fits(spark, two, numbers, loss):
    """The least subgradient vanishes, with one block and with many, at the optimum of proximal gradients."""
    rows, n = (numbers, 9) if loss == "squared_epsilon" else (two, 12)
    fits = [sparse_linear.fit(spark, rows, n, loss, c=0.2, block=b, tolerance=1e-5) for b in (256, 3)]
    data = linear.prepared(rows, n, loss)[0].toArrow().combine_chunks().to_batches()[0]
    got = linear.Sparse(data)
    for m in fits:
        slope = 0.2 * got.back(linear._loss(loss, got.margins(m.weights), got.y, 0.1)[1] * got.weight[:, None], n)[0]
        assert m.fitted.converged and np.abs(sparse_linear.subgradient(m.weights[0], slope)).max() < 1e-2
        assert m.fitted.value == pytest.approx(fits[0].fitted.value, rel=1e-6)
    small = sparse_linear.fit(spark, rows, n, loss, c=0.05)
    assert (small.weights != 0).sum() < (fits[0].weights != 0).sum()
    assert (sparse_linear.fit(spark, rows, n, loss, c=1e-6).weights == 0).all()


def test_block_step():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(6, 6))
    h, g, w = a @ a.T + 0.5 * np.eye(6), rng.normal(size=6) * 3, rng.normal(size=6)
    d = sparse_linear.block_step(w, g, h)
    assert np.abs(sparse_linear.subgradient(w + d, g + h @ d)).max() < 1e-6


def _groups(spark, kind, n=60, seed=7, classes=2):
    rng, rows = np.random.default_rng(seed), []
    for name, size in (("a", n), ("b", 8), ("c", n // 2)):
        for i in range(size):
            x = rng.normal(size=2)
            y = float(np.sin(x[0]) + x[1] ** 2) if kind.endswith("svr") else float(int(abs(x[0] * 2 + x[1])) % classes)
            rows.append((name, len(rows), None if i % 4 == 3 else 1.0 if name == "c" and classes == 2 and not kind.endswith("svr") else y, x.tolist()))
    rows += [("d", 1000 + i, None, [0.1, 0.2]) for i in range(12)]  # no label
    return spark.createDataFrame(rows, "`group` string, id long, y double, x array<double>").repartition(3)


@pytest.mark.parametrize("kind", kernel.TYPES)
def test_large_kernels(spark, kind):
    """Groups over the limit: the predictions of one task, and optimality of what was solved."""
    df = _groups(spark, kind)
    options = {"kind": kind, "kernel": "rbf", "gamma": 0.8, "c": 2.0, "nu": 0.3, "epsilon": 0.05}
    one = {r["id"]: r["pred"] for r in kernel.by_group(spark, df, **options).collect()}
    many = {r["id"]: r["pred"] for r in kernel.by_group(spark, df, most=10, working=32, **options).collect()}
    assert set(one) == set(many)
    near = [abs(one[i] - many[i]) < 0.02 if kind.endswith("svr") else one[i] == many[i] for i in one if one[i] is not None]
    # a one-class machine's free vectors lie on its surface, to the tolerance, on either side
    assert np.mean(near) >= (0.85 if kind == "one_class" else 0.97) and all((many[i] is None) == (one[i] is None) for i in one)


def test_large_kernel_decisions(spark):
    """Decision values of the cluster's solution are those of one task to the solver's tolerance, for rows to predict too."""
    df = _groups(spark, "c_svc").where("`group` = 'a'")
    rows = sorted((r["id"], r["y"], r["x"]) for r in df.collect())
    x, y = np.array([r[2] for r in rows]), np.array([np.nan if r[1] is None else r[1] for r in rows])
    known = ~np.isnan(y)
    machine = kernel.train(x[known], y[known], "c_svc", "rbf", c=2.0, gamma=0.8)
    problems = df.selectExpr("0 AS problem", "id AS row", "y", "x", "1.0D AS pos", "0.0D AS neg", "1L AS n_pos", "1L AS n_neg")
    got = {r["row"]: r["z"] for r in large_kernel.decisions(spark, problems, kernel="rbf", c=2.0, gamma=0.8, working=24).collect()}
    want = machine.decision(x)
    assert [got[r[0]] for r in rows] == pytest.approx(want.tolist(), abs=0.01)
    with pytest.raises(ValueError):
        large_kernel.decisions(spark, problems, kernel="precomputed")


@pytest.mark.parametrize("kind", ["c_svc", "one_class", "epsilon_svr"])
def test_large_kernels_of_noise(spark, kind):
    """Where labels say nothing and most rows are at their limits, no working set is needed; where pivots are too many they are."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.random((120, 2)) * [6, 1], rng.random((40, 2)) * [6, 1]])
    x[100:120] = x[:20]
    y = rng.standard_normal(160) if kind.endswith("svr") else (rng.random(160) < 0.5).astype(float)
    y[100:120] = y[:20]
    plus, known = int(y[:120].sum()), np.arange(160) < 120
    rows = [(0, i, float(y[i]) if known[i] else None, x[i].tolist(), 1.0, 0.0, plus, 120 - plus) for i in range(160)]
    problems = spark.createDataFrame(rows, "problem int, row long, y double, x array<double>, pos double, neg double, n_pos long, n_neg long").repartition(3)
    options = {"kind": kind, "kernel": "rbf", "gamma": 0.5, "nu": 0.4, "tolerance": 1e-3}
    want = kernel.train(x[known], y[known], **{k: v for k, v in options.items() if k != "tolerance"}).decision(x)
    for more in ({"rounds": 0}, {"rank": 5, "working": 64}):
        got = {r["row"]: r["z"] for r in large_kernel.decisions(spark, problems, **options, **more).collect()}
        assert [got[i] for i in range(160)] == pytest.approx(want.tolist(), abs=0.02), more


def test_large_kernel_classes(spark):
    df = _groups(spark, "c_svc", classes=3)
    options = {"gamma": 0.8, "c": 5.0}
    one, many = ({r["id"]: r["pred"] for r in kernel.by_group(spark, df, most=m, working=40, **options).where("pred = pred").collect()} for m in (5000, 10))
    assert np.mean([one[i] == many[i] for i in one if i < 1000]) >= 0.97


@pytest.mark.parametrize("loss", crossfeatures.LOSSES)
def test_cross_folds(spark, two, numbers, loss):
    """All folds' models at once are the models fitted one by one."""
    from pyspark.sql import functions as F

    rows, n = (numbers, 9) if loss == "squared_epsilon" else (two, 12)
    rows = rows.withColumn("fold", (F.abs(F.xxhash64("idx", "val")) % 3).cast("int"))
    model = crossfeatures.fit(spark, rows, n, 3, loss, c=0.3, tolerance=1e-8)
    assert model.weights.shape == (3, n + 1) and model.fitted.converged
    one = linear.fit(spark, rows.where("fold <> 1"), n, loss, c=0.3, solver="newton", tolerance=1e-8)
    assert model.weights[1] == pytest.approx(one.weights[0], abs=1e-5)


def test_feature_groups(spark):
    """Features that speak for one class in every fold lie apart from those for the other; features without a weight have no group."""
    rng, rows = np.random.default_rng(6), []
    for i in range(240):
        y = i % 2
        own = rng.choice(4, 2, replace=False) + (0 if y else 4)
        rows.append((i % 4, float(y), sorted([*own.tolist()]), [1.0, 1.0]))
    df = spark.createDataFrame(rows, "fold int, y double, idx array<int>, val array<double>")
    got = {r["id"]: r["cluster"] for r in crossfeatures.groups(spark, df, 10, 4, 2, c=1.0).collect()}
    assert set(got) == set(range(8)) and len({got[i] for i in range(4)}) == len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[4]
