"""The learner on graphs against a dense solution and against repeated synchronous updates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.operators import transductive as T


def _graph(n, seed, linked=0.1):
    rng = np.random.default_rng(seed)
    w = np.triu(np.where(rng.random((n, n)) < linked, rng.uniform(0.2, 3, (n, n)), 0), 1)
    w = w + w.T
    w[-1], w[:, -1] = 0, 0  # a node of its own
    labelled = rng.random(n) < 0.3
    labelled[-1] = False
    return w, labelled, rng.integers(0, 2, n).astype(float), rng.random(n)


def _dense(w, labelled, y, prior, alpha=1.0, beta=0.1, eta=0.7):
    free = ~labelled
    c = w * np.where(labelled, alpha, beta)[None, :]
    d = c.sum(1)
    f = np.where(labelled, y, prior)
    held = free & (d > 0)
    a = np.diag(d[held]) - eta * c[np.ix_(held, held)]
    b = eta * c[np.ix_(held, labelled)] @ y[labelled] + (1 - eta) * d[held] * prior[held]
    f[held] = np.linalg.solve(a, b + eta * c[np.ix_(held, free & ~held)] @ prior[free & ~held])
    return f


def _frames(spark, w, labelled, y, prior):
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, w double")
    state = spark.createDataFrame([(i, float(y[i]) if labelled[i] else None, float(prior[i]), bool(labelled[i])) for i in range(len(y))], "id long, y double, prior double, labelled boolean")
    return edges, state


@pytest.mark.parametrize("rates", [{}, {"alpha": 0.5, "beta": 0.5, "eta": 0.9}])
def test_solution(spark, rates):
    graph = _graph(40, 1)
    edges, state = _frames(spark, *graph)
    got = T.solve(spark, edges, state, tolerance=1e-7, **rates)
    f = {r["id"]: r["f"] for r in got.collect()}
    assert [f[i] for i in range(40)] == pytest.approx(_dense(*graph, **rates).tolist(), abs=1e-5)
    assert f[39] == pytest.approx(graph[3][39])  # without a neighbour: the prior
    assert T.objective_gap(edges, got, state, **rates) < 1e-5


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_all_or_none_labelled(spark, share):
    w, _, y, prior = _graph(20, 2, 0.3)
    labelled = np.full(20, share == 1.0)
    edges, state = _frames(spark, w, labelled, y, prior)
    f = {r["id"]: r["f"] for r in T.solve(spark, edges, state, tolerance=1e-7).collect()}
    assert [f[i] for i in range(20)] == pytest.approx(_dense(w, labelled, y, prior).tolist(), abs=1e-5)
    assert T.solve(spark, edges.limit(0), state, tolerance=1e-7).count() == 20


def test_learn(spark):
    """Two clusters, few labels: neighbours settle what the classifier leaves open; weights are those of the formula."""
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for i in range(60):
        side = i % 2
        v = np.array([1.0, 0.1] if side else [0.1, 1.0]) + rng.normal(0, 0.05, 2)
        v /= np.linalg.norm(v)
        t = np.array([0.8, 0.2] if side else [0.2, 0.8])
        rows.append((i, float(side) if i < 12 else None, [0], [float(rng.normal() + (0.5 if side else -0.5))], v.tolist(), t.tolist() if i % 7 else None))
        pairs += [(i, (i + 2 * k) % 60) for k in range(1, 6)] + [(i, int(rng.integers(0, 60)))]
    docs = spark.createDataFrame(rows, "id long, y double, idx array<int>, val array<double>, vector array<double>, topics array<double>")
    links = spark.createDataFrame(pairs, "src long, dst long")
    edges = {(r["src"], r["dst"]): r["w"] for r in T.weighted(links, docs).collect()}
    assert all((b, a) in edges and a != b and edges[b, a] == pytest.approx(w) for (a, b), w in edges.items())
    a, b = next((a, b) for a, b in edges if a % 7 and b % 7 and a % 2 != b % 2)
    p, q = (np.array(rows[i][5]) for i in (a, b))
    assert edges[a, b] == pytest.approx(np.exp(np.dot(rows[a][4], rows[b][4]) - ((p - q) * np.log(p / q)).sum() / 2))
    got = T.learn(spark, docs, links, 1, alpha=1.0, beta=1.0, eta=0.99).collect()
    assert len(got) == 60 and np.mean([r["label"] == r["id"] % 2 for r in got]) >= 0.9
    assert all(r["f"] == r["id"] % 2 for r in got if r["id"] < 12)
    alone = T.learn(spark, docs, links.where(F.lit(False)), 1).collect()
    assert len(alone) == 60 and all(0 <= r["f"] <= 1 for r in alone)
