"""Models against single-process numpy versions, invariants and small known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.operators import bayes as B
from corpuloom.functions import special
from corpuloom.operators import clusters, embedding, kernel, linear, network, optimize, similarity, topics
from corpuloom.operators import sequence_topics as H


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(40):
        lo = 0 if d % 2 else 10
        words = np.concatenate([rng.integers(lo, lo + 10, 30), rng.integers(0, 20, 5)])
        i, n = np.unique(words, return_counts=True)
        rows.append((d, i.tolist(), n.astype(float).tolist()))
    return spark.createDataFrame(rows, "doc_id long, idx array<int>, tf array<double>")


def test_two_topic_and_plsa_steps():
    background = np.array([0.4, 0.3, 0.2, 0.1])
    idx, tf = np.array([0, 2]), np.array([3.0, 1.0])
    theta = np.full(4, 0.25)
    s = topics.two_topic_estep(tf, idx, theta, background, 0.5)
    assert s == pytest.approx([3 * 0.125 / (0.125 + 0.2), 0.125 / (0.125 + 0.1)])
    theta, history = topics.two_topic(idx, tf, background)
    assert theta.sum() == pytest.approx(1) and history == sorted(history)
    model = topics.Model(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]]), background, np.full(2, 1.0), 0.3, smoothing=(1.0, 1.0))
    new, stat, ll = topics.plsa_estep(idx, tf, np.array([0.5, 0.5]), model)
    mix = np.array([0.4, 0.1])
    noise = 0.3 * background[idx] / (0.3 * background[idx] + 0.7 * mix)
    want = tf * (1 - noise) * 0.5 * model.beta[:, idx] / mix
    assert stat == pytest.approx(want) and new == pytest.approx(want.sum(1) / want.sum())
    assert ll == pytest.approx(tf @ np.log(0.7 * mix + 0.3 * background[idx]))


@pytest.mark.parametrize("kind", ["plsa", "lda"])
def test_topic_fits(spark, docs, kind):
    model, theta = topics.fit(spark, docs, topics.start(2, 20, alpha=1.0 if kind == "plsa" else 0.5, beta=1.0001), kind, rounds=12, tolerance=0)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))  # exact EM never falls
    rows = theta.collect()
    assert len(rows) == 40 and all(sum(r["theta"]) == pytest.approx(1) for r in rows)
    best = {r["doc_id"]: int(np.argmax(r["theta"])) for r in rows}
    assert len({best[d] for d in range(0, 40, 2)}) == 1 and best[0] != best[1]
    assert topics.top_words(model, [str(i) for i in range(20)], 3)[0][1] == 1
    held = topics.infer(spark, docs, model, kind)
    figure = topics.perplexity(held).first()
    assert 1 < figure["perplexity"] < 20 and figure["words"] == 40 * 35


def test_plsa_groups_and_priors(spark, docs):
    groups = docs.select("doc_id", (F.col("doc_id") % 2).alias("group"))
    prior = np.zeros((2, 20))
    prior[0, :10] = prior[1, 10:] = 50
    _, theta = topics.fit(spark, docs, topics.start(2, 20), "plsa", rounds=4, word_prior=prior, groups=groups)
    best = {r["doc_id"]: int(np.argmax(r["theta"])) for r in theta.collect()}
    assert best[1] == 0 and best[0] == 1  # seed words name the topics


def test_gibbs(spark, docs):
    model, theta = topics.gibbs(spark, docs, 2, 20, sweeps=10)
    best = {r["doc_id"]: int(np.argmax(r["theta"])) for r in theta.collect()}
    assert sum(best[d] == best[0] for d in range(0, 40, 2)) >= 18 and best[0] != best[1]
    assert model.beta.sum(1) == pytest.approx([1, 1])


def hmm_brute(emission, log_theta, epsilon):
    """Sum and best over all paths of (topic, drawn)."""
    n, k = emission.shape
    paths = {(t,): log_theta[t] + emission[0, t] for t in range(k)}
    for t in range(1, n):
        paths = {
            (*p, s): v + emission[t, s % k] + (np.log(epsilon) + log_theta[s] if s < k else np.log(1 - epsilon))
            for p, v in paths.items() for s in range(2 * k) if s < k or p[-1] % k == s % k
        }
    values = np.array(list(paths.values()))
    return np.log(np.exp(values).sum()), max(paths, key=paths.get), paths


def test_forward_backward_and_viterbi():
    rng = np.random.default_rng(1)
    emission, theta = np.log(rng.random((4, 2))), np.log(np.array([0.3, 0.7]))
    rates = np.full(3, 0.3)
    total, best, paths = hmm_brute(emission, theta, 0.3)
    ll, topic, drawn, _ = H.forward_backward(emission, theta, rates, rates)
    assert ll == pytest.approx(total)
    weights = {p: np.exp(v - total) for p, v in paths.items()}
    for t in range(4):
        for k in range(2):
            assert topic[t, k] == pytest.approx(sum(w for p, w in weights.items() if p[t] % 2 == k))
            assert drawn[t, k] == pytest.approx(sum(w for p, w in weights.items() if p[t] == k))
    assert tuple(H.viterbi(emission, theta, rates, rates)) == best
    ll, topic, _, changed = H.forward_backward(emission, theta, rates, rates, sentiment=True)
    assert topic.sum(1) == pytest.approx(np.ones(4)) and 0 <= changed.max() <= 1


def test_sentences_of_a_later_slice():
    """A slice that begins after documents with sentences has its own ones."""
    import pyarrow as pa

    docs = [[{"idx": [d, d + 1], "tf": [1.0, float(d)]}] * (d % 3) for d in range(9)]
    column = pa.array(docs, pa.list_(pa.struct([("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.float64()))])))
    for at in range(9):
        s, want = H.Sentences.of(column[at : at + 4]), [x for d in docs[at : at + 4] for x in d]
        assert s.sizes.tolist() == [len(d) for d in docs[at : at + 4]]
        assert s.idx.tolist() == [i for x in want for i in x["idx"]] and s.tf.tolist() == [t for x in want for t in x["tf"]]


@pytest.mark.parametrize("sentiment", [False, True])
def test_sequences_in_batches(sentiment):
    """All documents at once give what one after the other gives."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sizes, k = [3, 0, 1, 7, 2, 7], 4
    value = [[{"idx": sorted(rng.choice(12, 3, replace=False).tolist()), "tf": rng.integers(1, 4, 3).astype(float).tolist()} for _ in range(n)] for n in sizes]
    value[3].insert(2, {"idx": [], "tf": []})  # left out
    column = pa.array([[], *value], pa.list_(pa.struct([("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.float64()))])))[1:]
    s = H.Sentences.of(column)
    assert s.sizes.tolist() == sizes
    log_beta = np.log(rng.dirichlet(np.ones(12), k))
    emission = s.emissions(np.ascontiguousarray(log_beta.T))
    theta, eps, sig = rng.dirichlet(np.ones(k), len(sizes)), rng.uniform(0.1, 0.9, s.n), rng.uniform(0.1, 0.9, s.n)
    ll, topic, new, moved = H.forward_backward_all(s, emission, theta, eps, sig, sentiment)
    path = H.viterbi_all(s, emission, np.log(theta), eps, sig, sentiment)
    for d, stns in enumerate(value):
        stns = [(np.array(x["idx"]), np.array(x["tf"])) for x in stns if x["idx"]]
        if not stns:
            assert ll[d] == 0
            continue
        rows = slice(s.first[d], s.first[d] + s.sizes[d])
        one = H.emissions(stns, log_beta)
        assert emission[rows] == pytest.approx(one)
        want = H.forward_backward(one, np.log(theta[d]), eps[rows][1:], sig[rows][1:], sentiment)
        assert ll[d] == pytest.approx(want[0]) and topic[rows] == pytest.approx(want[1]) and new[rows] == pytest.approx(want[2]) and moved[rows] == pytest.approx(want[3])
        assert path[rows].tolist() == H.viterbi(one, np.log(theta[d]), eps[rows][1:], sig[rows][1:], sentiment).tolist()
        x = s.features()[rows]
        for t in range(1, len(stns)):
            (i, a), (j, b) = stns[t - 1], stns[t]
            _, p, q = np.intersect1d(i, j, return_indices=True)
            assert x[t] == pytest.approx([(a[p] * b[q]).sum() / np.sqrt((a**2).sum() * (b**2).sum()), np.log((b.sum() + 1) / (a.sum() + 1)), t / len(stns)])


def test_losses_with_corners(spark):
    """Hinge and absolute losses against a grid of weights; three classes one against the rest; a large group's kernel machine."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(60)
    rows = spark.createDataFrame([(i, float(y), [0], [float(v)]) for i, (v, y) in enumerate(zip(x, x + rng.standard_normal(60) * 0.5))], "id long, y double, idx array<int>, val array<double>")
    y = np.array([r["y"] for r in rows.orderBy("id").collect()])
    for loss, target, value in (
        ("hinge", (y > 0).astype(float), lambda w, b: np.maximum(0, 1 - np.sign(y) * (w * x + b)).sum()),
        ("epsilon", y, lambda w, b: np.maximum(0, np.abs(w * x + b - y) - 0.1).sum()),
    ):
        data = spark.createDataFrame([(i, float(t), [0], [float(v)]) for i, (v, t) in enumerate(zip(x, target))], "id long, y double, idx array<int>, val array<double>")
        whole = lambda w, b: (w * w + b * b) / 2 + value(w, b)  # noqa: B023, E731
        w, b = linear.fit(spark, data, 1, loss, rounds=200).weights[0]
        best = min(whole(p, q) for p in np.linspace(-3, 3, 121) for q in np.linspace(-2, 2, 81))
        assert whole(w, b) <= best + 60 * linear.CORNER / 2
    three = rows.withColumn("y", F.when(F.col("val")[0] < -0.5, 0).when(F.col("val")[0] < 0.5, 1).otherwise(2)).withColumn("idx", F.array(F.lit(0), F.lit(1))).withColumn("val", F.array(F.col("val")[0], F.col("val")[0] * F.col("val")[0]))
    model = linear.svc(spark, three, 2, c=10.0)
    assert model.weights.shape == (3, 3) and linear.predict(spark, three, model).join(three.select("id", "y"), "id").where("pred = y").count() >= 52
    groups = rows.select((F.col("id") % 2).cast("string").alias("group"), "id", F.when(F.col("id") % 5 != 0, (F.abs(F.col("val")[0]) < 0.7).cast("double")).alias("y"), "val")
    groups = groups.withColumnRenamed("val", "x")
    small, large = (kernel.by_group(spark, groups, most=m, gamma=1.0, c=10.0).collect() for m in (5000, 10))
    assert len(small) == len(large) == 60
    truth = {i: abs(v) < 0.7 for i, v in enumerate(x)}
    for got in (small, large):
        assert sum((r["pred"] > 0.5) == truth[r["id"]] for r in got) >= 52


def lda_plain(idx, tf, model, rounds):
    """Mean field of one document, in log space: its topics, statistics and the bound."""
    gammaln, digamma = special.lgamma, special.digamma
    logb, gamma = np.log(model.beta[:, idx]), model.alpha + tf.sum() / len(model.alpha)
    for _ in range(rounds):
        logphi = logb + digamma(gamma)[:, None]
        logphi = logphi - special.logsumexp(logphi, axis=0)[None, :]
        gamma = model.alpha + np.exp(logphi) @ tf
    phi, elog = np.exp(logphi), digamma(gamma) - digamma(gamma.sum())
    bound = gammaln(model.alpha.sum()) - gammaln(model.alpha).sum() + ((model.alpha - 1) * elog).sum()
    bound = bound + (tf * (phi * (elog[:, None] + logb - logphi)).sum(0)).sum() - gammaln(gamma.sum()) + gammaln(gamma).sum() - ((gamma - 1) * elog).sum()
    return gamma, phi * tf, float(bound)


def test_topics_in_batches():
    rng = np.random.default_rng(6)
    model = topics.Model(rng.dirichlet(np.ones(9), 3), rng.dirichlet(np.ones(9)), np.array([0.5, 1.0, 0.2]), 0.3, smoothing=(1.1, 1.0))
    docs = [(np.sort(rng.choice(9, n, replace=False)), rng.integers(1, 6, n).astype(float)) for n in (4, 9, 1)] + [(np.empty(0, int), np.empty(0))]
    tokens = topics.Tokens(np.concatenate([i for i, _ in docs]).astype(int), np.concatenate([t for _, t in docs]), np.repeat(np.arange(4), [len(i) for i, _ in docs]), 4)
    terms, theta = np.ascontiguousarray(model.beta.T), rng.dirichlet(np.ones(3), 4)
    new, stat, ll = topics.plsa_batch(tokens, theta, model, terms)
    gamma, phi, bound, _ = topics.lda_batch(tokens, None, model, terms, rounds=200, tolerance=1e-12)
    for d, (idx, tf) in enumerate(docs[:3]):
        want = topics.plsa_estep(idx, tf, theta[d], model)
        assert new[d] == pytest.approx(want[0]) and stat[tokens.doc == d] == pytest.approx(want[1].T) and ll[d] == pytest.approx(want[2])
        want = lda_plain(idx, tf, model, 200)
        assert gamma[d] == pytest.approx(want[0], rel=1e-6) and phi[tokens.doc == d] == pytest.approx(want[1].T, rel=1e-5) and bound[d] == pytest.approx(want[2], rel=1e-6)
    assert gamma[3] == pytest.approx(model.alpha) and new[3] == pytest.approx(np.full(3, 1 / 3))


def test_strangers(spark):
    """Everyone gets as many strangers as wanted, or all there are: few users, one with nearly all as friends."""
    users = spark.range(12).select(F.col("id").alias("user_id"))
    pairs = [(0, i) for i in range(1, 10)] + [(i, 0) for i in range(1, 10)] + [(3, 4), (4, 3)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = network.non_neighbours(edges, users, 2)
    friends, found = {}, {}
    for a, b in pairs:
        friends.setdefault(a, set()).add(b)
    for r in got.collect():
        found.setdefault(r["src"], []).append(r["dst"])
    for u, f in friends.items():
        assert len(found[u]) == len(set(found[u])) == min(2 * len(f), 11 - len(f)) and not set(found[u]) & (f | {u})


def test_strangers_without_broadcasts(spark, monkeypatch):
    """Neither users nor edges are sent whole, and draws are not shuffled: each user's are cut to want + degree before."""
    users = spark.range(300).select(F.col("id").alias("user_id"))
    edges = spark.range(300).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") + i) % 300 for i in (1, 2, 298, 299)])).alias("dst"))
    plans = []
    real = network.Scratch.table
    monkeypatch.setattr(network.Scratch, "table", lambda self, df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(self, df, name))[1])
    got = network.non_neighbours(edges, users, 2)
    plans.append(("out", got._jdf.queryExecution().executedPlan().toString()))
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan and name != "ranked"]  # ranked: a row per range
    drawn = dict(plans)["drawn-8"]
    assert drawn.index("LeftAnti") < drawn.rindex("Window") < drawn.index("Generate") and "Exchange" not in drawn[drawn.rindex("Window") : drawn.index("Generate")]
    found = [(r["src"], r["dst"]) for r in got.collect()]
    assert len(found) == len(set(found)) == 300 * 8 and all(2 < (b - a) % 300 < 298 for a, b in found)


def test_hidden_topic_fit(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(30):
        stns = [{"idx": sorted(set((rng.integers(0, 5, 4) + 5 * ((s // 3 + d) % 2)).tolist()))} for s in range(6)]
        rows.append((d, [(s["idx"], [1.0] * len(s["idx"])) for s in stns]))
    docs = spark.createDataFrame(rows, "doc_id long, stns array<struct<idx:array<int>,tf:array<double>>>")
    model, theta = H.fit(spark, docs, H.start(2, 10, seed=3), rounds=12)
    assert model.history[-1] > model.history[0] and model.epsilon < 0.6
    out = {r["doc_id"]: r["topics"] for r in H.paths(spark, docs, theta, model).collect()}
    assert sum(len(set(t[:3])) == 1 and len(set(t[3:])) == 1 for t in out.values()) >= 27
    logistic, _ = H.fit(spark, docs, H.start(2, 10, seed=3, sentiment=True, logistic=True), rounds=3)
    assert logistic.omega is not None and np.isfinite(logistic.omega).all()


OBJECTIVES = {  # start, optimum
    "rosenbrock": (lambda x: (100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])), (-1.2, 1.0), (1, 1)),
    "quadratic": (lambda x: (float(x @ np.diag([1, 10]) @ x), 2 * np.array([1, 10]) * x), (3.0, -2.0), (0, 0)),
}


@pytest.mark.parametrize("name", OBJECTIVES)
def test_optimizers(name):
    f, start, want = OBJECTIVES[name]
    out = optimize.lbfgs(f, np.array(start), rounds=200)
    assert out.x == pytest.approx(want, abs=1e-4)
    boxed = optimize.projected(f, lambda x: np.clip(x, -2, 0.5), np.array(start), rounds=20000)
    assert boxed.x[0] <= 0.5 and boxed.value <= f(np.clip(np.array(start), -2, 0.5))[0]
    quasi = optimize.projected(f, lambda x: np.clip(x, -2, 0.5), np.array(start), rounds=2000, quasi=True)
    assert quasi.value == pytest.approx(boxed.value, rel=0.05, abs=0.02)


def linear_rows(spark, classes=2):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        y = i % classes
        x = rng.normal(0, 0.4, 3)
        x[y % 3] += 2
        rows.append((i, float(y), [0, 1, 2], x.tolist()))
    return spark.createDataFrame(rows, "id long, y double, idx array<int>, val array<double>")


@pytest.mark.parametrize("loss,classes", [("logistic", 2), ("squared_hinge", 2), ("multinomial", 3), ("crammer_singer", 3)])
def test_linear(spark, loss, classes):
    rows = linear_rows(spark, classes)
    model = linear.fit(spark, rows, 3, loss, rounds=25)
    got = linear.predict(spark, rows, model).join(rows.select("id", "y"), "id")
    assert got.where(F.col("pred") == F.col("y")).count() >= 114
    f = linear.objective(rows.withColumn("weight", F.lit(1.0)).withColumn("y", F.when(F.col("y") == 0, -1.0).otherwise(1.0) if classes == 2 else F.col("y")), model.weights.shape, loss, 1.0, 0.1)
    w = model.weights.ravel()
    value, g = f(w)
    for k in (0, 3):  # the gradient is that of the value
        e = np.zeros(w.size)
        e[k] = 1e-5
        assert (f(w + e)[0] - f(w - e)[0]) / 2e-5 == pytest.approx(g[k], abs=1e-2)


def test_linear_variants(spark):
    rows = linear_rows(spark)
    sparse_model = linear.fit(spark, rows, 3, "logistic", c=0.2, l1=True, rounds=40)
    assert abs(sparse_model.weights[0, 2]) < 0.05  # the feature that says nothing
    target = rows.withColumn("y", F.expr("2 * val[0] - val[1] + 1"))
    svr = linear.fit(spark, target, 3, "squared_epsilon", c=10, rounds=40)
    figures = linear.regression_figures(linear.predict(spark, target, svr).join(target.select("id", "y"), "id")).first()
    assert figures["mse"] < 0.05 and figures["r2"] > 0.98
    folds = rows.withColumn("fold", F.col("id") % 3)
    assert linear.cross_validate(spark, folds, 3, 3, loss="logistic", rounds=8).count() == 120
    weights = spark.createDataFrame([(1, [-1.0, 2.0, 0.0])], "user_id long, w array<double>")
    posts = spark.createDataFrame([(1, 7, [(0, 1.0)]), (1, 8, [(1, 1.0)])], "user_id long, id long, features array<struct<idx:int,val:double>>")
    assert {r["id"]: r["pred"] for r in linear.per_user(posts, weights).collect()} == {7: 1, 8: 0}
    svc = linear.svc(spark, rows, 3)
    assert linear.predict(spark, rows, svc).join(rows.select("id", "y"), "id").where("pred = y").count() >= 114


def ring():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (120, 2))
    return x, np.where((x**2).sum(1) < 1, 1.0, -1.0)


@pytest.mark.parametrize("kind", ["c_svc", "nu_svc"])
def test_kernel_classifiers(kind):
    x, y = ring()
    m = kernel.train(x, y, kind, "rbf", c=10, nu=0.2, gamma=1.0, probability=True)
    assert (m.predict(x) == y).mean() > 0.93
    p = m.probability(x)
    assert p.sum(1) == pytest.approx(np.ones(120)) and ((p[:, 0] > 0.5) == (y > 0)).mean() > 0.9
    if kind == "c_svc":  # optimality: free vectors lie on the margin
        k = kernel.gram(x, m.vectors, "rbf", gamma=1.0) @ m.coefficients - m.rho
        assert np.all(y[np.abs(y * k) > 1.5] * k[np.abs(y * k) > 1.5] > 0)


def test_kernel_others():
    x, y = ring()
    three = np.where(x[:, 0] > 0.5, 2.0, y)
    m = kernel.train(x, three, "c_svc", "rbf", c=10, gamma=1.0, probability=True)
    assert (m.predict(x) == three).mean() > 0.9 and m.probability(x[:5]).sum(1) == pytest.approx(np.ones(5))
    one = kernel.train(x, None, "one_class", "rbf", nu=0.2, gamma=0.5)
    assert 0.1 < (one.predict(x) < 0).mean() < 0.35
    z = np.linspace(-2, 2, 60)[:, None]
    for kind in ("epsilon_svr", "nu_svr"):
        svr = kernel.train(z, np.sin(z[:, 0]), kind, "rbf", c=50, nu=0.5, epsilon=0.05, gamma=1.0)
        assert np.abs(svr.predict(z) - np.sin(z[:, 0])).max() < 0.25
    for name in ("linear", "poly", "sigmoid"):
        assert kernel.gram(x[:3], x[:2], name, gamma=0.5, coef0=0.0).shape == (3, 2)
    assert kernel.couple(np.array([[0, 0.9, 0.8], [0.1, 0, 0.4], [0.2, 0.6, 0]])).argmax() == 0


def test_random_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.7, (6, 2))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    z = np.array([r["z"] for r in df.select("id", kernel.fourier(F.col("v"), 2, 400, 0.5).alias("z")).orderBy("id").collect()])
    assert z @ z.T == pytest.approx(kernel.gram(x, x, "rbf", gamma=0.5), abs=0.2)


def test_label_propagation(spark):
    edges = [(i, i + 1, 1.0) for i in range(9)] + [(i + 1, i, 1.0) for i in range(9)]
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    state = spark.createDataFrame([(i, float(i == 9), 0.5, i in (0, 9)) for i in range(10)], "id long, f double, prior double, labelled boolean")
    out = similarity.propagate(spark, e, state, beta=1.0, eta=0.9)
    f = {r["id"]: r["f"] for r in out.collect()}
    assert all(f[i] < f[i + 1] for i in range(9)) and f[0] == 0 and f[9] == 1
    again = similarity.propagation_step(e, out.select("id", "f", "prior", "labelled"), beta=1.0, eta=0.9)
    assert again.agg(F.max("delta")).first()[0] < 1e-3
    votes = similarity.majority_step(e, state.select("id", (F.col("id") > 4).cast("int").alias("y"), "labelled"))
    assert votes.count() == 10


def test_clusters(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.02 * i] if i < 5 else [0.02 * i, 1.0]) for i in range(10)] + [(10, [0.0, 0.0])], "id long, vector array<double>")
    model, out = clusters.cosine_kmeans(rows, 2)
    c = {r["id"]: r["cluster"] for r in out.collect()}
    assert len(c) == 10 and len({c[i] for i in range(5)}) == 1 and c[0] != c[9]
    edges = spark.createDataFrame([(0, 1), (1, 0), (0, 9)], "src long, dst long")
    assert clusters.link_counts(out, edges).agg(F.sum("n")).first()[0] == 3


def test_bayes_em(spark):
    counts = spark.createDataFrame([(0, "a", 3), (1, "b", 3), (2, "a", 1), (2, "c", 5), (3, "c", 4), (4, "b", 1), (4, "d", 4)], "doc_id long, term string, tf long")
    labelled = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, y int")
    model = B.semi_supervised(spark, counts, labelled, most=6)
    pred = {r["doc_id"]: r["pred"] for r in B.predict(B.scores(counts, model)).collect()}
    assert pred == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}  # c is learned through document 2
    scores = B.scores(counts, model).groupBy("doc_id").agg(F.sum("posterior").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in scores)


# The joint embedding


def reference_doc(idx, tf, mu, root, mu_u, sigma_u, state):
    """One sweep of a document, word by word and topic by topic."""
    p, k = state.params, len(mu)
    length = tf.sum()
    zeta = lambda m, s: np.log(np.exp(m + 0.5 * s).sum())
    phi = np.exp(mu[:, None] + state.log_beta[:, idx])
    phi /= phi.sum(0)
    stat = phi @ tf
    z = zeta(mu, root**2)
    last = 1.0
    for _ in range(31):
        value = 0.0
        for t in range(k):
            dot = state.mu_phi[t] @ mu_u
            moment = length * np.exp(mu[t] + 0.5 * root[t] ** 2 - z)
            value += -0.5 * p.tau * mu[t] ** 2 + p.tau * mu[t] * dot + mu[t] * stat[t] - moment
            mu[t] += p.step * (-p.tau * mu[t] + p.tau * dot + stat[t] - moment)
        if abs((last - value) / last) <= 1e-6:
            break
        last = value
    z, last = zeta(mu, root**2), 1.0
    for _ in range(31):
        value = 0.0
        for t in range(k):
            moment = length * np.exp(mu[t] + 0.5 * root[t] ** 2 - z)
            value += -0.5 * p.tau * root[t] ** 2 - moment + 0.5 * np.log(root[t] ** 2)
            root[t] += p.step * (-p.tau * root[t] - root[t] * moment + 1 / root[t])
        if abs((last - value) / last) <= 1e-6:
            break
        last = value
    return mu, root, phi


def toy_state(topics_=2, dim=2, vocabulary=5):
    rng = np.random.default_rng(4)
    b = rng.random((topics_, vocabulary))
    a = rng.random((dim, dim))
    return embedding.State(embedding.Params(topics=topics_, dim=dim), np.log(b / b.sum(1)[:, None]), rng.random((topics_, dim)), a @ a.T + np.eye(dim))


def test_embedding_document_sweep():
    state, rng = toy_state(), np.random.default_rng(5)
    docs = [(np.array([0, 2, 3]), np.array([2.0, 1.0, 4.0])), (np.array([1]), np.array([3.0]))]
    mu, root, mu_u = rng.random((2, 2)), 1 + rng.random((2, 2)), rng.random((2, 2))
    sigma_u = np.stack([np.eye(2), 2 * np.eye(2)])
    batch = embedding.Batch(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), np.array([0, 3, 4]))
    got = embedding.infer_docs(batch, mu.copy(), root.copy(), mu_u, sigma_u, state, 1)
    for i, (idx, tf) in enumerate(docs):
        want = reference_doc(idx, tf, mu[i].copy(), root[i].copy(), mu_u[i], sigma_u[i], state)
        assert got[0][i] == pytest.approx(want[0], abs=1e-8) and got[1][i] == pytest.approx(want[1], abs=1e-8)
        assert got[2][batch.doc == i] == pytest.approx(want[2].T)
    longer = embedding.infer_docs(batch, mu.copy(), root.copy(), mu_u, sigma_u, state, 50)
    assert (longer[3] >= got[3] - 1e-9).all()  # the bound rises


def test_embedding_long_documents():
    state, rng = toy_state(), np.random.default_rng(5)
    batch = embedding.Batch(np.arange(5), np.full(5, 6000.0), np.array([0, 5]))
    got = embedding.infer_docs(batch, rng.random((1, 2)), 1 + rng.random((1, 2)), rng.random((1, 2)), np.eye(2)[None], state, 40)
    assert all(np.isfinite(x).all() for x in got) and np.abs(got[0]).max() < 50


def test_embedding_pairs_and_users():
    rng = np.random.default_rng(6)
    p = embedding.Params(topics=2, dim=2, rho=0.4)
    delta, root, eps, eps1 = embedding.first_pairs(0, 0, 3, 3, p)
    edge, own = np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]], float), np.eye(3, dtype=bool)
    mu = rng.random((3, 2))
    dots = mu @ mu.T
    before = embedding.pair_bound(delta, root, eps, eps1, edge, dots, dots**2, p, own)
    after = embedding.ascend_pairs(delta, root, eps, eps1, edge, dots, p, own)
    assert embedding.pair_bound(*after, edge, dots, dots**2, p, own) > before
    assert np.diag(after[0]) == pytest.approx(np.diag(delta))
    i, j = 0, 1  # one step of one pair by hand
    t = (0 * 0.6 / eps1[i, j] - 1 / eps[i, j]) * np.exp(delta[i, j] + 0.5 * root[i, j] ** 2)
    one = embedding.Params(topics=2, dim=2, rho=0.4, ascent_rounds=1)
    stepped = embedding.ascend_pairs(delta, root, eps, eps1, edge, dots, one, own)
    assert stepped[0][i, j] == pytest.approx(delta[i, j] + 1e-3 * (1 + t - (delta[i, j] - dots[i, j]) / 4))
    state = toy_state()
    sigmas = np.stack([np.eye(2)] * 3)
    second = sigmas + mu[:, :, None] * mu[:, None, :]
    new_mu, new_sigma = embedding.user_update(mu[0], sigmas[0], 2, np.array([1.0, 2.0]), np.where(own, 0, delta)[0] @ mu, second.sum(0), state)
    q = state.params
    precision = q.gamma * np.eye(2) + sum(second[j] for j in (1, 2)) / q.xi**2
    pull = sum(delta[0, j] * mu[j] for j in (1, 2)) / q.xi**2
    for k in range(2):
        precision = precision + q.tau * 2 * (state.sigma_phi + np.outer(state.mu_phi[k], state.mu_phi[k]))
        pull = pull + q.tau * (1.0, 2.0)[k] * state.mu_phi[k]
    assert new_sigma == pytest.approx(np.linalg.inv(precision)) and new_mu == pytest.approx(new_sigma @ pull)


def test_embedding_fit(spark, docs):
    owned = docs.withColumn("user_id", F.concat(F.lit("u"), (F.col("doc_id") % 6).cast("string")))
    edges = spark.createDataFrame([(f"u{i}", f"u{j}") for i in range(6) for j in range(6) if i != j and (i - j) % 2 == 0], "src string, dst string")
    flags = frozenset({"alpha", "beta", "gamma", "tau", "xi", "rho"})
    params = embedding.Params(topics=2, dim=3, em_rounds=2, var_rounds=2, block=4, rho=0.5, flags=flags)
    fitted = embedding.fit(spark, owned.where("doc_id < 30"), edges, 20, params)
    assert all(np.isfinite(fitted.state.history)) and fitted.users.count() == 6
    for r in fitted.users.collect():
        assert np.linalg.eigvalsh(np.array(r["sigma"]).reshape(3, 3)).min() > 0
    held = embedding.infer(spark, owned.where("doc_id >= 30"), fitted, rounds=3)
    assert held.count() == 10 and topics.perplexity(held).first()["perplexity"] > 1
    whole = embedding.fit(spark, owned.where("doc_id < 30"), edges, 20, embedding.Params(**{**params.__dict__, "block": 100}))
    assert fitted.state.history[-1] == pytest.approx(whole.state.history[-1], rel=0.2)  # blocks change the start and the stopping test only


def test_pairs_of_blocks(spark, monkeypatch):
    """Pairs of several blocks, against all pairs by hand; nothing of their number is shuffled."""
    from corpuloom.operators import similarity

    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "MATCHES", 5)
    x = np.random.default_rng(3).random((40, 12)) * (np.random.default_rng(4).random((40, 12)) < 0.2)
    vectors = spark.createDataFrame([(i, f"t{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "doc_id long, term string, w double")
    queries = vectors.where("doc_id % 3 = 0")
    met = {(q, d): (x[q] > 0) & (x[d] > 0) for q in range(0, 40, 3) for d in range(40) if q != d}
    met = {p: m for p, m in met.items() if m.any()}
    norm, n = np.sqrt((x**2).sum(1)), (x > 0).sum(1)
    want = {
        "cosine": {(q, d): x[q] @ x[d] / norm[q] / norm[d] for q, d in met},
        "jaccard": {(q, d): m.sum() / (n[q] + n[d] - m.sum()) for (q, d), m in met.items()},
        "rbf": {(q, d): np.exp(-((x[q] - x[d])[m] ** 2).sum() / 0.5) for (q, d), m in met.items()},
    }
    got = {"cosine": similarity.cosine_pairs(queries, vectors), "jaccard": similarity.jaccard_pairs(queries, vectors), "rbf": similarity.rbf_pairs(queries, vectors, 0.5)}
    for name, pairs in got.items():
        assert {(r["q"], r["d"]): pytest.approx(r["sim"]) for r in pairs.collect()} == want[name]
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "Exchange hashpartitioning" not in plan
