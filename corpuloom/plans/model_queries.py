"""Queries of similarity, classification, topic models, embeddings and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions import arrays as A
from corpuloom.operators import bayes as B
from corpuloom.operators import corpus as C
from corpuloom.operators import similarity as S
from corpuloom.operators import weighting as W
from corpuloom.plans import common as P
from corpuloom.plans.common import r6
from corpuloom.plans.registry import query
from corpuloom.session import Scratch, ship

# Similarity: documents whose doc_id is divisible by 50 are the queries against all.


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.weighted(P.counts(spark, sf_dir, lengths=True), "tfidf")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("doc_id") % 50 == 0)


_TF = f"""{P.STATS}, w AS (SELECT doc_id, term, tf::DOUBLE / len * ln((n + 1) / df::DOUBLE) AS w FROM st),
pr AS (SELECT a.doc_id AS q, b.doc_id AS d, sum(a.w * b.w) AS dot, count(*) AS shared, sum((a.w - b.w) * (a.w - b.w)) AS gap
       FROM w a JOIN w b USING (term) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM w GROUP BY doc_id)"""


@query(f"WITH {_TF} SELECT q, d, round(dot / (a.norm * b.norm), 6) AS sim FROM pr JOIN nm a ON a.doc_id = q JOIN nm b ON b.doc_id = d")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _tfidf(spark, sf_dir)
    return S.cosine_pairs(_queries(w), w).select("q", "d", r6("sim", "sim"))


@query(f"WITH {_TF} SELECT q, d, round(shared / (a.n + b.n - shared)::DOUBLE, 6) AS sim FROM pr JOIN nm a ON a.doc_id = q JOIN nm b ON b.doc_id = d")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _tfidf(spark, sf_dir)
    return S.jaccard_pairs(_queries(w), w).select("q", "d", r6("sim", "sim"))


@query(f"WITH {_TF} SELECT q, d, round(exp(-gap / 0.01), 6) AS sim FROM pr")
def rbf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _tfidf(spark, sf_dir)
    return S.rbf_pairs(_queries(w), w, 0.01).select("q", "d", r6("sim", "sim"))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.l2_normalized(F.col("embedding").cast("array<double>"))
    return P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vector"), F.col("label").alias("y"))


_KNN = """kn AS (SELECT a.vec_id AS q, b.vec_id AS d, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, d) AS rank FROM kn)"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = _unit(spark, sf_dir)
    return S.knn(spark, v.where(F.col("id") % 50 == 0), v, k)


@query(f"WITH {_KNN} SELECT q, d, round(sim, 6) AS sim, rank FROM rk WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 10).select("q", "d", r6("sim", "sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_KNN} SELECT a.label AS y, round(avg((a.label = b.label)::INT) FILTER (rank <= 5), 6) AS p_at_5, round(avg((a.label = b.label)::INT) FILTER (rank <= 10), 6) AS p_at_10,
round(avg((a.label = b.label)::INT) FILTER (rank <= 20), 6) AS p_at_20 FROM rk JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = d WHERE rank <= 20 GROUP BY a.label""")
def neighbor_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.neighbour_purity(_neighbours(spark, sf_dir, 20), _unit(spark, sf_dir).select("id", "y"))
    return out.select(F.col("yq").alias("y"), *[r6(f"p_at_{k}", f"p_at_{k}") for k in (5, 10, 20)])


@query(f"WITH {_KNN} SELECT q, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std FROM rk WHERE rank <= 10 GROUP BY q")
def similarity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similarity_spread(_neighbours(spark, sf_dir, 10)).select("q", r6("mean", "mean"), r6("std", "std"))


_PROP = """st AS (SELECT vec_id AS id, (label % 2)::DOUBLE AS f, 0.25 AS prior, vec_id % 3 = 0 AS labelled FROM embeddings),
ed AS (SELECT vec_id AS src, (vec_id * 7 + j * 13) % (SELECT count(*) FROM embeddings) AS dst, (1 + (vec_id + j) % 5)::DOUBLE AS w FROM embeddings, unnest([1, 2, 3, 4]) AS t(j)),
nr AS (SELECT src, sum(CASE WHEN labelled THEN 1.0 ELSE 0.1 END * w * f) AS top, sum(CASE WHEN labelled THEN 1.0 ELSE 0.1 END * w) AS bottom FROM ed JOIN st ON id = dst GROUP BY src)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph of four arithmetic neighbours a vector, a third of them labelled."""
    e = P.table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    state = e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("double").alias("f"), F.lit(0.25).alias("prior"), (F.col("vec_id") % 3 == 0).alias("labelled"))
    j = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("j")
    edges = e.select("vec_id", j).crossJoin(F.broadcast(n)).select(
        F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + F.col("j") * 13) % F.col("n")).alias("dst"), (1 + (F.col("vec_id") + F.col("j")) % 5).cast("double").alias("w")
    )
    return edges, state


@query(f"""WITH {_PROP} SELECT id, round(CASE WHEN NOT labelled AND bottom > 0 THEN 0.7 * top / bottom + 0.3 * prior ELSE f END, 6) AS f FROM st LEFT JOIN nr ON src = id""")
def label_prop_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.propagation_step(*_graph(spark, sf_dir)).select("id", r6("f", "f"))


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the fixed point (tested: one more step moves nothing)."""
    state = S.propagate(spark, *_graph(spark, sf_dir))
    return S.nearest_class(state, {0: 0.5, 1: 0.5}).select("id", r6("f", "f"), "label")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT vec_id, x, list_transform(x, lambda v: abs(v) / list_sum(list_transform(x, lambda u: abs(u)))) AS p FROM e)
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm, round(list_sum(x), 6) AS total,
round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)), 6) AS entropy,
round(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 6) AS lse,
list_position(x, list_max(x)) - 1 AS argmax, round(1 / (1 + exp(-x[1])), 6) AS logistic FROM p""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return P.table(spark, sf_dir, "embeddings").select(
        "vec_id", r6(A.l2_norm(x), "norm"), r6(A.total(x), "total"), r6(A.entropy(A.l1_absolute(x)), "entropy"), r6(A.log_sum_exp(x), "lse"),
        A.argmax(x).cast("long").alias("argmax"), r6(A.logistic(x[0]), "logistic"),
    )


_PAIRED = """e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: abs(v) + 0.001) AS a FROM embeddings),
pr AS (SELECT q.vec_id AS a, d.vec_id AS b, q.x AS x, d.x AS y, q.a AS u, d.a AS v FROM e q JOIN e d ON d.vec_id = q.vec_id + 1)"""


@query(f"""WITH {_PAIRED}, n AS (SELECT a, b, x, y, list_transform(u, lambda t: t / list_sum(u)) AS p, list_transform(v, lambda t: t / list_sum(v)) AS q FROM pr)
SELECT a, b, round(list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[1] / t[2]) + t[2] * ln(t[2] / t[1]))), 6) AS kl,
round(list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 6) AS gap,
round(list_sum(list_transform(list_zip(x, y, range(1, 65)), lambda t: (t[1] - t[2]) * (t[1] - t[2]) * t[3])), 6) AS mahalanobis FROM n""")
def kl_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of neighbours in order: symmetric KL of magnitudes, squared Euclid, Mahalanobis with a diagonal matrix."""
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    u = A.l1_normalized(F.transform("x", lambda v: F.abs(v) + 0.001))
    left, right = e.select(F.col("vec_id").alias("a"), F.col("x").alias("x"), u.alias("p")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("x").alias("y"), u.alias("q"))
    n = F.size("x")
    matrix = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.when(i == j, i.cast("double")).otherwise(F.lit(0.0))))
    return left.join(right, "a").select("a", "b", r6(A.kl_symmetric(F.col("p"), F.col("q")), "kl"), r6(A.squared_distance(F.col("x"), F.col("y")), "gap"), r6(A.mahalanobis(F.col("x"), F.col("y"), matrix), "mahalanobis"))


@query("""WITH r AS (SELECT l_orderkey AS query, l_linenumber::BIGINT * 1000000 + l_partkey AS item, l_quantity::BIGINT % 3 AS relevance, l_extendedprice / 1000 AS f1, l_discount AS f2 FROM lineitem)
SELECT a.query, a.item AS better, b.item AS worse, round(a.f1 - b.f1, 6) AS d1, round(a.f2 - b.f2, 6) AS d2 FROM r a JOIN r b ON a.query = b.query AND a.relevance > b.relevance""")
def rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results of their order's query."""
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("item"),
        (F.col("l_quantity").cast("long") % 3).alias("relevance"), F.array(F.col("l_extendedprice") / 1000, "l_discount").alias("features"),
    )
    return S.ranking_pairs(rows).select("query", "better", "worse", r6(F.col("diff")[0], "d1"), r6(F.col("diff")[1], "d2"))


@query()
def lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's longest common subsequence of words with the one before it."""
    from pyspark.sql import Window

    from corpuloom.functions.special import lcs_length as lcs

    ship(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = P.table(spark, sf_dir, "conversations").withColumn("words", F.split("text", " "))
    paired = turns.withColumn("before", F.lag("words").over(w)).where(F.col("before").isNotNull())
    return paired.select("conv_id", "turn", lcs("words", "before").alias("lcs"))


# Naive Bayes on labelled documents; those with doc_id % 4 = 3 are tests.

_NB = f"""{P.CNT}, lab AS (SELECT doc_id, quality AS y FROM labels WHERE doc_id % 4 <> 3 AND doc_id IN (SELECT doc_id FROM documents)),
pri AS (SELECT y, ln(count(*)) AS log_prior FROM lab GROUP BY y),
sm AS (SELECT y, term, sum(tf)::DOUBLE AS c FROM cnt JOIN lab USING (doc_id) GROUP BY y, term),
vs AS (SELECT count(DISTINCT term) AS v FROM sm),
tot AS (SELECT y, ln(sum(c) + v * 0.1) AS lt FROM sm CROSS JOIN vs GROUP BY y, v)"""
_NBP = f"""{_NB}, tm AS (SELECT t.y, k.term, ln(0.1 + coalesce(sm.c, 0)) - t.lt AS lp FROM (SELECT DISTINCT term FROM sm) k CROSS JOIN tot t LEFT JOIN sm ON sm.y = t.y AND sm.term = k.term),
jt AS (SELECT c.doc_id, p.y, log_prior + coalesce(sum(tf * lp), 0) AS j FROM (SELECT DISTINCT doc_id FROM cnt) c CROSS JOIN pri p
       LEFT JOIN cnt USING (doc_id) LEFT JOIN tm ON tm.term = cnt.term AND tm.y = p.y GROUP BY c.doc_id, p.y, log_prior),
po AS (SELECT doc_id, y, j, exp(j - (max(j) OVER w + ln(sum(exp(j - mj)) OVER w))) AS posterior FROM (SELECT *, max(j) OVER (PARTITION BY doc_id) AS mj FROM jt) WINDOW w AS (PARTITION BY doc_id)),
pd AS (SELECT doc_id, arg_max(y, (j, -y)) AS pred FROM jt GROUP BY doc_id)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labels(spark, sf_dir).join(P.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def _nb(spark: SparkSession, sf_dir: str):
    counts = P.counts(spark, sf_dir)
    train = _labelled(spark, sf_dir).where(F.col("doc_id") % 4 != 3)
    return counts, B.train(counts, train.withColumn("q", F.lit(1.0)))


@query(f"WITH {_NB} SELECT sm.y, term, round(ln(0.1 + c) - lt, 6) AS log_p, round(log_prior, 6) AS log_prior FROM sm JOIN tot USING (y) JOIN pri USING (y)")
def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors, terms = _nb(spark, sf_dir)[1]
    return terms.where(F.col("term").isNotNull()).join(priors, "y").select("y", "term", r6("log_p", "log_p"), r6("log_prior", "log_prior"))


@query(f"WITH {_NBP} SELECT doc_id, y, round(j, 6) AS log_joint, round(posterior, 6) AS posterior FROM po")
def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, model = _nb(spark, sf_dir)
    return B.scores(counts, model).select("doc_id", "y", r6("log_joint", "log_joint"), r6("posterior", "posterior"))


@query(f"WITH {_NBP} SELECT doc_id, pred FROM pd")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, model = _nb(spark, sf_dir)
    return B.predict(B.scores(counts, model))


_CM = f"{_NBP}, cm AS (SELECT pred, quality AS y, count(*) AS n FROM pd JOIN labels USING (doc_id) WHERE doc_id % 4 = 3 GROUP BY 1, 2)"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _labelled(spark, sf_dir).where(F.col("doc_id") % 4 == 3)
    return B.confusion(nb_predict(spark, sf_dir).join(test, "doc_id"))


@query(f"WITH {_CM} SELECT pred, y, n FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(f"""WITH {_CM}, s AS (SELECT pred AS c, sum(n) AS said FROM cm GROUP BY pred), i AS (SELECT y AS c, sum(n) AS real FROM cm GROUP BY y), t AS (SELECT y AS c, n AS tp FROM cm WHERE pred = y),
f AS (SELECT c, coalesce(tp, 0) / nullif(said, 0)::DOUBLE AS p, coalesce(tp, 0) / nullif(real, 0)::DOUBLE AS r FROM s FULL JOIN i USING (c) LEFT JOIN t USING (c))
SELECT c AS y, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
(SELECT round(coalesce(sum(n) FILTER (pred = y), 0) / sum(n)::DOUBLE, 6) FROM cm) AS accuracy FROM f""")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _confusion(spark, sf_dir)
    figures = B.precision_recall(table).crossJoin(F.broadcast(B.accuracy(table)))
    return figures.select("y", *[r6(c, c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"""WITH {_NBP}, cm AS (SELECT doc_id % 5 AS fold, pred, quality AS y, count(*) AS n FROM pd JOIN labels USING (doc_id) GROUP BY 1, 2, 3),
f AS (SELECT fold, sum(n) FILTER (pred = y AND y = 1) / (coalesce(sum(n) FILTER (pred = 1), 0) + 0.001) AS p, sum(n) FILTER (pred = y AND y = 1) / (coalesce(sum(n) FILTER (y = 1), 0) + 0.001) AS r FROM cm GROUP BY fold)
SELECT round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_std, round(avg(r), 6) AS recall_mean, round(stddev_pop(r), 6) AS recall_std FROM f""")
def fold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed precision and recall of class 1 in five folds: mean and deviation."""
    rows = nb_predict(spark, sf_dir).join(_labelled(spark, sf_dir), "doc_id").withColumn("fold", F.col("doc_id") % 5)
    one = lambda c: F.count(F.when(c, 1))
    tp = one((F.col("pred") == 1) & (F.col("y") == 1))
    figures = rows.groupBy("fold").agg((tp / (one(F.col("pred") == 1) + 0.001)).alias("precision"), (tp / (one(F.col("y") == 1) + 0.001)).alias("recall")).withColumn("all", F.lit(1))
    out = B.across_folds(figures, ["all"], ["precision", "recall"])
    return out.select(*[r6(c, c) for c in ("precision_mean", "precision_std", "recall_mean", "recall_std")])


@query(f"""WITH {_NBP}, wt AS (SELECT doc_id, y, 1.0::DOUBLE AS q FROM lab UNION ALL SELECT doc_id, y, posterior FROM po WHERE doc_id NOT IN (SELECT doc_id FROM lab)),
s2 AS (SELECT y, term, sum(tf * q) AS c FROM cnt JOIN wt USING (doc_id) GROUP BY y, term), v2 AS (SELECT count(DISTINCT term) AS v FROM s2),
t2 AS (SELECT y, ln(sum(c) + v * 0.1) AS lt FROM s2 CROSS JOIN v2 GROUP BY y, v), p2 AS (SELECT y, ln(sum(q) + 0.1) AS lp FROM wt GROUP BY y)
SELECT y, term, round(ln(0.1 + c) - lt, 5) AS log_p, round(lp, 5) AS log_prior FROM s2 JOIN t2 USING (y) JOIN p2 USING (y)""")
def nb_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, model = _nb(spark, sf_dir)
    labelled = _labelled(spark, sf_dir).where(F.col("doc_id") % 4 != 3)
    priors, terms = B.em_step(counts, labelled, model)
    return terms.where(F.col("term").isNotNull()).join(priors, "y").select("y", "term", F.round("log_p", 5).alias("log_p"), F.round("log_prior", 5).alias("log_prior"))


@query()
def nb_semi_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM until the likelihood settles."""
    counts, labelled = P.counts(spark, sf_dir), _labelled(spark, sf_dir).where(F.col("doc_id") % 4 != 3)
    done = B.settled(spark, counts, labelled)
    return B.predict(done[1] if done else B.scores(counts, B.semi_supervised(spark, counts, labelled)))


# Topic models: one step in SQL terms, whole fits in Python

_STEP = f"""{P.CNT}, v AS (SELECT term, sum(tf) AS ttf, row_number() OVER (ORDER BY term) - 1 AS idx FROM cnt GROUP BY term HAVING count(*) > 5),
bg AS (SELECT term, idx, (1 + ttf)::DOUBLE / (SELECT sum(ttf) + count(*) FROM v) AS b FROM v),
be AS (SELECT term, idx, k, (1 + (idx * (k + 1)) % 7)::DOUBLE / sum(1 + (idx * (k + 1)) % 7) OVER (PARTITION BY k) AS beta FROM v, unnest([0, 1, 2]) AS t(k)),
th AS (SELECT doc_id, k, (1 + (doc_id + k) % 3)::DOUBLE / 6 AS theta FROM (SELECT DISTINCT doc_id FROM cnt), unnest([0, 1, 2]) AS t(k)),
mx AS (SELECT c.doc_id, c.term, c.tf, sum(theta * beta) AS s FROM cnt c JOIN be USING (term) JOIN th ON th.doc_id = c.doc_id AND th.k = be.k GROUP BY 1, 2, 3),
ex AS (SELECT m.doc_id, m.term, be.k, tf * (1 - 0.3 * b / (0.3 * b + 0.7 * s)) * theta * beta / s AS e
       FROM mx m JOIN be USING (term) JOIN th ON th.doc_id = m.doc_id AND th.k = be.k JOIN bg ON bg.term = m.term)"""


def plsa_step_inputs(spark: SparkSession, sf_dir: str):
    counts = P.counts(spark, sf_dir)
    vocab = C.indexed(C.vocabulary(counts, 5))
    background = C.background(vocab)
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 1, 2)])).alias("k")
    raw = vocab.select("term", "idx", k).withColumn("raw", 1 + (F.col("idx") * (F.col("k") + 1)) % 7)
    total = raw.groupBy("k").agg(F.sum("raw").alias("all"))
    beta = raw.join(F.broadcast(total), "k").select("term", "k", (F.col("raw") / F.col("all")).alias("beta"))
    theta = counts.select("doc_id").distinct().select("doc_id", k).withColumn("theta", (1 + (F.col("doc_id") + F.col("k")) % 3) / 6)
    return counts, background, beta, theta


@query(f"WITH {_STEP}, sm AS (SELECT k, term, sum(e) + 0.01 AS e FROM ex GROUP BY k, term) SELECT k, term, round(e / sum(e) OVER (PARTITION BY k), 9) AS p FROM sm")
def plsa_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step from fixed topics and shares, as relational operations."""
    from corpuloom.operators.topics import plsa_step

    counts, background, beta, theta = plsa_step_inputs(spark, sf_dir)
    return plsa_step(counts, theta, beta, background, lam=0.3, smoothing=0.01).select("k", "term", F.round("p", 9).alias("p"))


@query(f"""WITH {P.CNT}, v AS (SELECT term, sum(tf) AS ttf FROM cnt GROUP BY term), bg AS (SELECT term, (1 + ttf)::DOUBLE / (SELECT sum(ttf) + count(*) FROM v) AS b FROM v),
th AS (SELECT doc_id, term, tf, tf / sum(tf) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM cnt),
s AS (SELECT doc_id, term, tf * 0.5 * t / (0.5 * t + 0.5 * b) AS s FROM th JOIN bg USING (term))
SELECT doc_id, term, round((0.01 + s) / (sum(s) OVER (PARTITION BY doc_id) + (SELECT count(*) FROM v) * 0.01), 9) AS p FROM s""")
def two_topic_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per document from its empirical distribution against the corpus background."""
    from pyspark.sql import Window

    counts = P.counts(spark, sf_dir, lengths=True)
    vocab = Scratch(spark, "vocabulary").table(C.vocabulary(counts), "vocabulary")  # read three times
    size = vocab.agg(F.count(F.lit(1)).alias("v"))
    rows = counts.withColumn("t", F.col("tf") / F.col("len")).join(C.background(vocab).hint("shuffle_hash"), "term")
    s = rows.withColumn("s", F.col("tf") * 0.5 * F.col("t") / (0.5 * F.col("t") + 0.5 * F.col("p")))
    total = F.sum("s").over(Window.partitionBy("doc_id"))
    p = (0.01 + F.col("s")) / (total + F.col("v") * 0.01)
    return s.crossJoin(F.broadcast(size)).select("doc_id", "term", P.rounded(p, 9).alias("p"))


@query(f"""WITH {P.CNT}, v AS (SELECT term, sum(tf) AS ttf FROM cnt GROUP BY term), bg AS (SELECT term, (1 + ttf)::DOUBLE / (SELECT sum(ttf) + count(*) FROM v) AS b FROM v),
s AS (SELECT doc_id % 5 AS fold, doc_id, sum(tf * ln(b)) AS ll, sum(tf) AS words FROM cnt JOIN bg USING (term) GROUP BY 1, 2)
SELECT fold, round(exp(-sum(ll) / sum(words)), 6) AS perplexity, round(avg(ll), 6) AS avg_ll FROM s GROUP BY fold""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the background model, by fold."""
    from corpuloom.operators.topics import perplexity as figure

    counts = P.counts(spark, sf_dir)
    scored = counts.join(C.background(C.vocabulary(counts)), "term").groupBy((F.col("doc_id") % 5).alias("fold"), "doc_id").agg(F.sum(F.col("tf") * F.ln("p")).alias("ll"), F.sum("tf").alias("words"))
    return figure(scored, ["fold"]).select("fold", r6("perplexity", "perplexity"), r6("avg_ll", "avg_ll"))


@query(f"""WITH {_STEP}, rk AS (SELECT k, term, round(beta, 9) AS p, row_number() OVER (PARTITION BY k ORDER BY round(beta, 9) DESC, term) AS rank FROM be) SELECT k, term, p, rank FROM rk WHERE rank <= 20""")
def top_words_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = plsa_step_inputs(spark, sf_dir)[2]
    return C.top(beta.select("k", "term", F.round("beta", 9).alias("p")), "k", F.col("p"), "term", 20).select("k", "term", "p", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_STEP}, o AS (SELECT source, k, sum(theta) AS x FROM th JOIN documents USING (doc_id) GROUP BY source, k) SELECT source, k, round(x / sum(x) OVER (PARTITION BY source), 6) AS share FROM o""")
def topic_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's topics: the normalized sum of its documents' shares."""
    theta = plsa_step_inputs(spark, sf_dir)[3].join(P.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return C.l1(theta.groupBy("source", "k").agg(F.sum("theta").alias("share")), "source", "share").select("source", "k", r6("share", "share"))


#: Terms that the models know: all, or of more the ones in most documents (their tables are topics x terms).
MOST_TERMS = 200_000


def _known(counts: DataFrame, most: int | None = MOST_TERMS) -> DataFrame:
    """An indexed vocabulary of all terms, or of ``most`` at most."""
    from corpuloom.session import Scratch

    scratch = Scratch(counts.sparkSession, "known")
    vocab = scratch.table(C.vocabulary(counts, 0), "terms")
    if most is not None and vocab.count() > most:
        vocab = vocab.orderBy(F.desc("df"), "term").limit(most)
    return scratch.table(C.indexed(vocab), "vocabulary")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id").distinct()


def corpus(spark: SparkSession, sf_dir: str, most: int | None = MOST_TERMS):
    """Documents as arrays over an indexed vocabulary, the vocabulary, its size and background. Documents without a term have empty arrays."""
    from corpuloom.operators import topics as M
    from corpuloom.session import Scratch

    scratch = Scratch(spark, "corpus")
    counts = P.counts(spark, sf_dir)  # written
    vocab = _known(counts, most)
    terms = F.broadcast(vocab) if most is not None and most <= MOST_TERMS else vocab  # so many rows at most; counts stay where they are
    docs = _ids(spark, sf_dir).join(M.corpus(C.closed(counts, terms).select("doc_id", "idx", "tf")), "doc_id", "left")
    docs = docs.select("doc_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("tf", F.array().cast("array<double>")).alias("tf"))
    return scratch.table(docs, "docs"), vocab, vocab.count()


def _background(vocab: DataFrame):
    import numpy as np

    return np.array([r["p"] for r in C.background(vocab).join(vocab.select("term", "idx"), "term").orderBy("idx").select("p").collect()])  # vocabulary


@query()
def plsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.operators import topics as M

    docs, vocab, size = corpus(spark, sf_dir)
    model, theta = M.fit(spark, docs, M.start(5, size, background=_background(vocab), lam=0.3), "plsa")
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "share")).select("doc_id", "topic", r6("share", "share"))


@query()
def lda_vb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on four folds, the fifth's perplexity."""
    from corpuloom.operators import topics as M

    docs, _, size = corpus(spark, sf_dir)
    model, _ = M.fit(spark, docs.where(F.col("doc_id") % 5 != 0), M.start(5, size, alpha=1.1), "lda", learn_alpha=True)
    return M.perplexity(M.infer(spark, docs.where(F.col("doc_id") % 5 == 0), model, "lda"))


@query()
def lda_gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.operators import topics as M

    docs, vocab, size = corpus(spark, sf_dir)
    _, theta = M.gibbs(spark, docs, 5, size, sweeps=12)
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "share")).select("doc_id", "topic", r6("share", "share"))


def sentences(spark: SparkSession, sf_dir: str):
    """Documents as sentences over an indexed vocabulary of all terms; sentences end at punctuation. Documents without a term have none."""
    counts = P.sentence_counts(spark, sf_dir)
    vocab = Scratch(spark, "known").table(C.indexed(counts.select("term").distinct()), "vocabulary")
    pair = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("tf").cast("double").alias("tf"))))
    placed = C.closed(counts, vocab.hint("shuffle_hash")).repartition("doc_id")  # which serves both groupings
    stns = placed.groupBy("doc_id", "stn").agg(pair.alias("p"))
    docs = _ids(spark, sf_dir).join(stns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stn", "p"))).alias("s")), "doc_id", "left")
    return docs.select("doc_id", F.transform("s", lambda x: F.struct(x["p"]["idx"].alias("idx"), x["p"]["tf"].alias("tf"))).alias("stns")), vocab.count()


@query()
def htmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of sentences on the best path."""
    from corpuloom.operators import sequence_topics as H

    docs, size = sentences(spark, sf_dir)
    model, theta = H.fit(spark, docs, H.start(4, size))
    out = H.paths(spark, docs, theta, model)
    return out.select("doc_id", F.posexplode(F.arrays_zip("topics", "drawn")).alias("stn", "s")).select("doc_id", "stn", F.col("s.topics").alias("topic"), F.col("s.drawn").alias("drawn"))


@query()
def htsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With moods and logistic switching."""
    from corpuloom.operators import sequence_topics as H

    docs, size = sentences(spark, sf_dir)
    model, theta = H.fit(spark, docs, H.start(4, size, sentiment=True, logistic=True))
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "share")).select("doc_id", "topic", r6("share", "share"))


def _embedding_inputs(spark: SparkSession, sf_dir: str):
    docs, vocab, size = corpus(spark, sf_dir)
    owners = P.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("user_id"))
    owned = docs.join(owners, "doc_id")
    names = owners.select("user_id").distinct()
    n = F.regexp_extract("user_id", r"(\d+)", 1).cast("int")
    a, b = names.select(F.col("user_id").alias("src"), n.alias("i")), names.select(F.col("user_id").alias("dst"), n.alias("j"))
    edges = a.join(b, (F.abs(F.col("i") - F.col("j")) == 1) | (F.abs(F.col("i") - F.col("j")) == 5)).select("src", "dst")
    return owned, edges, size


@query()
def joint_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' embeddings: sources as users, their documents, a ring of friendships."""
    from corpuloom.operators import embedding as E

    docs, edges, size = _embedding_inputs(spark, sf_dir)
    fitted = E.fit(spark, docs.where(F.col("doc_id") % 5 != 0), edges, size, E.Params(em_rounds=1, var_rounds=1, topics=5, dim=5))
    return fitted.users.select("user_id", F.posexplode("mu").alias("dim", "value")).select("user_id", "dim", r6("value", "value"))


@query()
def cold_start_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out perplexity by stratum of the users' documents."""
    from corpuloom.operators import embedding as E
    from corpuloom.operators.topics import perplexity as figure
    from corpuloom.operators.users import stratum

    docs, edges, size = _embedding_inputs(spark, sf_dir)
    train = docs.where(F.col("doc_id") % 5 != 0)
    fitted = E.fit(spark, train, edges, size, E.Params(em_rounds=1, var_rounds=1, topics=5, dim=5))
    scored = E.infer(spark, docs.where(F.col("doc_id") % 5 == 0), fitted, rounds=5)
    degree = edges.groupBy(F.col("src").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    strata = fitted.index.join(degree, "user_id", "left").select("u", stratum(F.coalesce("n", F.lit(0)), 2, 3).alias("stratum"))
    return figure(scored.join(strata, "u"), ["stratum"])


# Linear and kernel models, clustering


def _rows(spark: SparkSession, sf_dir: str):
    """Labelled documents as rows over all terms that training rows (id % 4 <> 3) have; others have no weight in a penalized model.

    Terms that one document alone has are one feature, as long as they are together: their weights lie along the document's own
    values, so the model and its steps are the same.
    """
    from corpuloom.operators.ranking import global_rank

    scratch = Scratch(spark, "rows")
    labelled = scratch.table(_labelled(spark, sf_dir), "labelled")
    counts = scratch.table(P.counts(spark, sf_dir).join(labelled.select("doc_id"), "doc_id", "left_semi"), "counts")
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(F.col("doc_id") % 4 != 3).alias("train")).where("train")
    terms = scratch.table(seen, "terms")
    shared = scratch.table(C.indexed(terms.where("df > 1").select("term")), "shared")
    size = shared.count()
    vocab = shared.unionByName(terms.where("df = 1").select("term", F.lit(None).cast(shared.schema["idx"].dataType).alias("idx")))
    val = F.ln(1 + F.col("tf").cast("double"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").cast("int").alias("idx"), val.alias("val")))))
    own = F.sqrt(F.sum(F.when(F.col("idx").isNull(), val * val)))
    docs = scratch.table(counts.join(vocab.hint("shuffle_hash"), "term").groupBy("doc_id").agg(pairs.alias("p"), own.alias("own")), "docs")
    last = global_rank(docs.where("own is not null").select("doc_id"), ["doc_id"], "at")
    last = scratch.table(last.select("doc_id", (F.col("at") + size).cast("int").alias("at")), "own")
    docs = labelled.join(docs, "doc_id", "left").join(last, "doc_id", "left")
    more = lambda c, x, kind: F.concat(F.coalesce(c, F.array().cast(kind)), F.when(F.col("at").isNotNull(), F.array(x)).otherwise(F.array().cast(kind)))
    idx, val = more(F.col("p.idx"), F.col("at"), "array<int>"), more(F.col("p.val"), F.col("own"), "array<double>")
    return scratch.table(docs.select(F.col("doc_id").alias("id"), "y", idx.alias("idx"), val.alias("val")), "all"), size + last.count()


@query()
def logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.operators import linear as L

    rows, size = _rows(spark, sf_dir)
    model = L.fit(spark, rows.where(F.col("id") % 4 != 3), size, "multinomial", c=0.1)
    return L.predict(spark, rows.where(F.col("id") % 4 == 3), model).select("id", "pred")


@query()
def linear_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.operators import linear as L

    rows, size = _rows(spark, sf_dir)
    model = L.svc(spark, rows.where(F.col("id") % 4 != 3), size, c=0.01)
    return L.predict(spark, rows.where(F.col("id") % 4 == 3), model).select("id", "pred")


@query()
def linear_regression_svr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from quantity and discount by support vector regression."""
    from corpuloom.operators import linear as L

    rows = P.table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("id"), (F.col("l_extendedprice") / 10000).alias("y"),
        F.array(F.lit(0), F.lit(1)).alias("idx"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("val"),
    )
    model = L.fit(spark, rows, 2, "squared_epsilon", c=0.001, rounds=10)
    return L.regression_figures(L.predict(spark, rows, model).join(rows.select("id", "y"), "id")).select(r6("mse", "mse"), r6("r2", "r2"))


@query()
def kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine per month of events: types apart by value and hour."""
    from corpuloom.operators import kernel as KM

    events = P.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    rows = events.select(
        F.date_format("ts", "yyyyMM").alias("group"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_type") == "click").cast("double")).alias("y"),
        F.array(F.ln(1 + F.abs("value")), F.hour("ts") / 24.0).alias("x"),
    )
    return KM.by_group(spark, rows, kind="c_svc", kernel="rbf", gamma=2.0)


@query()
def kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.operators.clusters import cosine_kmeans

    rows = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return cosine_kmeans(rows, 8)[1]
