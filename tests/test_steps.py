"""Steps of models that don't grow with what they once multiplied."""

import numpy as np
import pytest

from corpuloom.operators import dual, linear, topics


def test_inference_with_the_terms_beside_the_documents(spark):
    """Chances in the documents' rows give what a broadcast model gives."""
    rng = np.random.default_rng(3)
    beta = rng.dirichlet(np.ones(9), 2)
    rows = [(d, sorted(rng.choice(9, d % 4 + 1, replace=False).tolist()), [1.0 + i for i in range(d % 4 + 1)]) for d in range(30)]
    schema = "doc_id long, idx array<int>, tf array<double>"
    alpha, none = np.full(2, 0.5), np.zeros(0)
    want = topics.infer(spark, spark.createDataFrame(rows, schema), topics.Model(beta, np.full(9, 1 / 9), alpha), "lda", rounds=3)
    with_terms = [(d, i, t, beta[:, i].T.ravel().tolist()) for d, i, t in rows]
    got = topics.infer(spark, spark.createDataFrame(with_terms, schema + ", beta array<double>"), topics.Model(np.zeros((2, 0)), none, alpha), "lda", rounds=3)
    want, got = ({r["doc_id"]: [*r["theta"], r["ll"]] for r in x.collect()} for x in (want, got))
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_plsa_step_has_no_row_per_topic(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3)], "doc_id long, term string, tf long")
    theta = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 1, 1.0)], "doc_id long, k long, theta double")  # document 2 lacks a topic
    beta = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.1), ("b", 0, 0.5), ("b", 1, 0.9)], "term string, k long, beta double")
    background = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "term string, p double")
    got = topics.plsa_step(counts, theta, beta, background, 0.3, 0.01)
    assert "Window" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Window") == 1
    e: dict = {}
    for tf, p, part in ((2, 0.4, {0: 0.125, 1: 0.075}), (1, 0.6, {0: 0.125, 1: 0.675}), (3, 0.6, {1: 0.9})):
        s = sum(part.values())
        for k, x in part.items():
            term = "a" if p == 0.4 else "b"
            e[k, term] = e.get((k, term), 0.01) + tf * (1 - 0.3 * p / (0.3 * p + 0.7 * s)) * x / s
    assert {(r["k"], r["term"]): r["p"] for r in got.collect()} == pytest.approx({(k, t): v / sum(x for (j, _), x in e.items() if j == k) for (k, t), v in e.items()})


def test_sweep_of_many_documents_keeps_its_counts():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 1, 40])
    words = np.concatenate([rng.integers(0, 6, 6), rng.integers(6, 12, 40)])
    z, doc = rng.integers(0, 2, 46), np.repeat(np.arange(4), sizes)
    of = lambda z: (np.bincount(doc * 2 + z, minlength=8).reshape(-1, 2) + 0.5, np.bincount(words * 2 + z, minlength=24).reshape(-1, 2) + 0.1)
    own, terms = of(z)
    totals = terms.sum(0)
    for _ in range(20):
        topics.sweep_all(words, sizes, z, own, terms, totals, rng)
        a, b = of(z)
        assert own == pytest.approx(a) and terms == pytest.approx(b) and totals == pytest.approx(b.sum(0))
    assert max(np.bincount(z[6:], minlength=2)) >= 36  # words that go together share a topic


def test_equal_rows_are_one(spark):
    rng = np.random.default_rng(1)
    rows = [(float(y), [0, 1], [float(a), float(b)]) for a, b, y in zip(rng.integers(0, 3, 300), rng.integers(0, 3, 300), rng.choice([-1, 1], 300, p=[0.3, 0.7]))]
    data = spark.createDataFrame(rows, "y double, idx array<int>, val array<double>")
    assert linear.merged(linear.prepared(data, 2, "logistic")[0]).count() <= 18
    one, all_ = (linear.fit(spark, data, 2, "logistic", c=0.1, solver="newton", tolerance=1e-9, merge=m).weights for m in (True, False))
    assert one == pytest.approx(all_, abs=1e-6)
    one, all_ = (dual.fit(spark, data, 2, "hinge", c=0.1, tolerance=1e-4, merge=m).fitted for m in (True, False))
    assert one.converged and one.value == pytest.approx(all_.value, rel=2e-4)


def test_rounds_shuffle_no_document(spark, monkeypatch):
    """From the second round on documents meet their states in the buckets where both lie; nothing is left in the catalog."""
    rng = np.random.default_rng(5)
    rows = [(d, sorted(rng.choice(9, d % 4 + 1, replace=False).tolist()), [1.0] * (d % 4 + 1)) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, idx array<int>, tf array<double>")
    plans, real = {}, topics.Scratch.bucketed

    def seen(self, df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name, *rest)

    monkeypatch.setattr(topics.Scratch, "bucketed", seen)
    _, theta = topics.fit(spark, docs, topics.start(2, 9, alpha=1.1), "lda", rounds=2, tolerance=0)
    assert "Join" in plans["round-1"] and "Exchange" not in plans["round-1"]
    assert theta.count() == 40 and not [t for t in spark.catalog.listTables() if "topics" in t.name]


def test_gradients_come_as_arrays(spark, monkeypatch):
    """A partition gives a row per output and one for the value, whatever the number of weights, and there are few partitions."""
    rows = spark.range(0, 600, 1, 50).selectExpr("cast(id % 2 as double) AS y", "array(cast(id % 300 as int), 300) AS idx", "array(1.0D, 0.5D) AS val")
    seen, real = [], linear.objective

    def kept(data, shape, *rest, **more):
        seen.append((data.rdd.getNumPartitions(), shape))
        return real(data, shape, *rest, **more)

    monkeypatch.setattr(linear, "objective", kept)
    model = linear.fit(spark, rows, 301, "multinomial", c=0.1, rounds=3)
    assert seen == [(linear.PARTS * spark.sparkContext.defaultParallelism, (2, 302))] and model.weights.shape == (2, 302)
    data, classes, outputs = linear.prepared(rows, 301, "multinomial")
    batches = data.toArrow().to_batches()
    w = np.random.default_rng(0).normal(0, 0.1, (outputs, 302))
    made = [b for b in linear._gradient(iter(batches), w, "multinomial", 0.1)]
    assert [b.num_rows for b in made] == [3]
    value, grad = real(data, w.shape, "multinomial", 1.0, 0.1)(w.ravel())
    k, g = made[0].columns
    assert k.to_pylist() == [-1, 0, 1] and value == pytest.approx(0.5 * (w * w).sum() + g[0].as_py()[0])
    assert grad == pytest.approx(w.ravel() + np.array(g[1].as_py() + g[2].as_py()))


def test_two_topic_step_reads_its_counts_once(spark, sf):
    """The vocabulary is written once instead of being counted again for each use; rounding is that of decimals."""
    from pyspark.sql import functions as F

    from corpuloom.plans import common, model_queries

    plan = model_queries.two_topic_em_step(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "len#" in line for line in plan.splitlines()) == 1
    values = [(float(v),) for v in np.random.default_rng(2).random(500)] + [(0.0,), (1.0,), (1e-10,), (6e-10,)]
    rows = spark.createDataFrame(values, "x double").select(F.round("x", 9).alias("a"), common.rounded(F.col("x"), 9).alias("b"))
    assert rows.where("a <> b").count() == 0


def test_sequence_models_know_every_term(spark, tmp_path):
    """No term is left out, however many there are; the forward recursion's chances are those of the terms' places."""
    from corpuloom.plans import model_queries, step_queries

    rows = [(d, " ".join(f"w{d}x{i}" for i in range(41_000)) + ". end.") for d in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, size = model_queries.sentences(spark, str(tmp_path))
    assert size == 205_001
    assert [len(s["idx"]) for r in docs.collect() for s in r["stns"]] == [41_000, 1] * 5
    place = np.arange(size)
    for k, chances in enumerate(step_queries._chances(2, size)):
        want = 1 + place * (k + 1) % 7
        assert chances[place % 7] == pytest.approx(want / want.sum())


def test_semi_supervised_rounds_are_those_of_the_relational_step(spark, monkeypatch):
    """Passes over blocks of terms give the models that joins of the counts give."""
    from corpuloom.operators import bayes as B

    rng = np.random.default_rng(5)
    rows = [(d, f"t{t}", int(n)) for d in range(40) for t, n in enumerate(rng.poisson(0.6 + 0.5 * ((np.arange(12) + d) % 2))) if n]
    rows += [(d, f"own{d}", 2) for d in range(40)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    labelled = spark.createDataFrame([(d, d % 2 + 3) for d in range(8)] + [(99, 3), (0, 3)], "doc_id long, y int")  # one without a term, one twice
    monkeypatch.setattr(B, "POSTINGS", 50)
    hard = labelled.withColumn("q", B.F.lit(1.0))
    model = B.train(counts.join(labelled.select("doc_id"), "doc_id", "left_semi"), hard, 0.1, 0.1)
    for rounds in (1, 2):
        model = B.em_step(counts, labelled, model)
        weights, joint = B.settled(spark, counts, labelled, most=rounds, tolerance=0.0)
        want, got = ({(r["doc_id"], r["y"]): r["log_joint"] for r in x.collect()} for x in (B.scores(counts, model), joint))
        assert got == pytest.approx(want, rel=1e-9)
    assert weights.groupBy("doc_id").agg(B.F.sum("q").alias("q")).where("doc_id > 0 and abs(q - 1) > 1e-9").count() == 0


def test_semi_supervised_query_runs_until_it_settles(spark, sf, monkeypatch):
    from corpuloom.operators import bayes as B
    from corpuloom.plans import registry

    history, whole = [], B.settled
    monkeypatch.setattr(B, "settled", lambda *a, **k: whole(*a, **k, history=history))
    assert registry.QUERIES["nb_semi_supervised"](spark, sf).count()
    assert len(history) > 1 and abs(history[-1] / history[-2] - 1) < 1e-5


def test_linear_rows_keep_every_term_of_training(spark, tmp_path):
    """However many terms there are; those of one document alone are one feature of their length."""
    from corpuloom.plans import model_queries

    words = lambda at: " ".join(f"w{i}" for i in range(at, at + 41_000))
    texts = {0: words(0) + " common alone alone single", 1: words(0) + " " + words(50_000), 2: words(50_000) + " " + words(100_000), 4: words(100_000) + " " + words(150_000)}
    texts |= {5: words(150_000) + " " + words(200_000), 6: words(200_000), 3: "common w0 unseen", 7: "unseen"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d in texts], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, size = model_queries._rows(spark, str(tmp_path))
    got = {r["id"]: r for r in rows.collect()}
    assert size == 5 * 41_000 + 2 and len(got) == 8 and len(got[7]["idx"]) == 0
    assert len(got[0]["idx"]) == 41_002 and got[0]["idx"][-1] == size - 1  # alone, single: one feature
    assert got[0]["val"][-1] == pytest.approx(np.hypot(np.log(3), np.log(2)))
    assert len(got[3]["idx"]) == 2 and set(got[3]["idx"]) < set(got[0]["idx"])


@pytest.mark.parametrize("loss", ["hinge", "multinomial"])
def test_own_terms_as_one_feature_take_the_same_steps(loss):
    """L-BFGS goes the same way whether a row's own features are many or one of their length, and so decides the same."""
    from corpuloom.operators.optimize import lbfgs

    rng = np.random.default_rng(4)
    shared, own = rng.random((12, 5)), [rng.random(1 + r % 3) for r in range(12)]
    many, one = np.zeros((12, sum(map(len, own)))), np.diag([np.linalg.norm(x) for x in own])
    for r, at in enumerate(np.cumsum([0, *map(len, own[:-1])])):
        many[r, at : at + len(own[r])] = own[r]
    place = np.arange(12) % 2
    y, outputs = (2.0 * place - 1, 1) if loss == "hinge" else (place.astype(float), 2)

    def decisions(x, rounds):
        def f(w):
            value, d = linear._loss(loss, x @ w.reshape(outputs, -1).T, y, 0.1)
            return 0.5 * w @ w + 0.7 * value.sum(), w + 0.7 * (d.T @ x).ravel()

        return x @ lbfgs(f, np.zeros(outputs * x.shape[1]), rounds=rounds).x.reshape(outputs, -1).T

    for rounds in (1, 3, 6):
        assert decisions(np.hstack([shared, many]), rounds) == pytest.approx(decisions(np.hstack([shared, one]), rounds), abs=1e-7)


def test_logistic_fits_of_packed_steps(spark):
    """Both outcomes end where their gradients vanish, however many steps lie in a row."""
    from corpuloom.operators import sequence_topics as H

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(60, 3)), rng.random(60), np.zeros(60)])
    x[:, 4] = x[:, 3] * rng.random(60)
    rows = spark.createDataFrame([(x[a:b].ravel().tolist(),) for a, b in ((0, 1), (1, 40), (40, 60))], "state array<double>")
    got = H.logistic_fits(rows, 3, 5, [(3, None, np.zeros(4)), (4, 3, np.full(4, 3.0))])
    design = np.column_stack([np.ones(60), x[:, :3]])
    for w, hit, whole in zip(got, (x[:, 3], x[:, 4]), (np.ones(60), x[:, 3])):
        assert design.T @ (whole / (1 + np.exp(-design @ w)) - hit) + 0.2 * w == pytest.approx(np.zeros(4), abs=1e-6)


def test_htsm_runs_until_it_settles(spark, sf, monkeypatch):
    """The registered query leaves the rounds to the operator."""
    from corpuloom.operators import sequence_topics as H
    from corpuloom.plans import registry

    seen: dict = {}
    monkeypatch.setattr(H, "fit", lambda spark, docs, model, **k: (seen.update(k), (model, docs.selectExpr("doc_id", "array(1d) AS theta")))[1])
    assert registry.QUERIES["htsm"](spark, sf).count() and not seen
