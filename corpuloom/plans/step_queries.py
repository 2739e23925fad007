"""Steps of the iterative models from fixed states, which SQL can say too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.plans import common as P
from corpuloom.plans.common import r6
from corpuloom.plans.registry import query


def _chances(topics: int, size: int) -> np.ndarray:
    """Topics x 7: a place's chance depends on its remainder by 7, and on how many places there are."""
    raw = 1.0 + np.arange(7)[None, :] * np.arange(1, topics + 1)[:, None] % 7
    held = np.array([len(range(r, size, 7)) for r in range(7)])  # places by remainder
    return raw / (raw @ held)[:, None]


def _vocabulary(topics: int) -> str:
    """All terms with their places and a fixed distribution over them for each topic."""
    listed = ", ".join(map(str, range(topics)))
    return f"""v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM cnt)),
be AS (SELECT term, k, (1 + (idx * (k + 1)) % 7)::DOUBLE / sum(1 + (idx * (k + 1)) % 7) OVER (PARTITION BY k) AS beta FROM v, unnest([{listed}]) AS t(k))"""


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    low = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y}^2) + 1 / (120 * {y}^4) - 1 / (252 * {y}^6) + 1 / (240 * {y}^8) - ({low}))"


@query(f"""WITH {P.CNT}, {_vocabulary(3)},
p1 AS (SELECT doc_id, term, k, tf, beta / sum(beta) OVER (PARTITION BY doc_id, term) AS phi FROM cnt JOIN be USING (term)),
g1 AS (SELECT doc_id, k, 0.5 + sum(tf * phi) AS g FROM p1 GROUP BY doc_id, k),
p2 AS (SELECT doc_id, term, k, tf, beta * exp({_digamma('g')}) AS u FROM cnt JOIN be USING (term) JOIN g1 USING (doc_id, k)),
q2 AS (SELECT doc_id, k, tf * u / sum(u) OVER (PARTITION BY doc_id, term) AS e FROM p2),
g2 AS (SELECT doc_id, k, 0.5 + sum(e) AS g FROM q2 GROUP BY doc_id, k)
SELECT doc_id, k AS topic, round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS share FROM g2""")
def lda_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of mean field from fixed topics: shares of the documents."""
    from corpuloom.operators import topics as M
    from corpuloom.plans.model_queries import corpus

    docs, _, size = corpus(spark, sf_dir, most=None)
    held = np.array([len(range(r, size, 7)) for r in range(7)])  # places by remainder
    totals = [float(held @ (1 + np.arange(7) * (k + 1) % 7)) for k in range(3)]
    chances = F.flatten(F.transform("idx", lambda i: F.array(*[(1 + (i.cast("long") * (k + 1)) % 7) / t for k, t in enumerate(totals)])))
    model = M.Model(np.zeros((3, 0)), np.zeros(0), np.full(3, 0.5))
    theta = M.infer(spark, docs.where(F.size("idx") > 0).withColumn("beta", chances), model, "lda", rounds=2)
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "share")).select("doc_id", "topic", r6("share", "share"))


@query(f"""WITH RECURSIVE {P.NORM},
seg AS (SELECT *, count(*) FILTER (tok = '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stn FROM norm),
cnt AS (SELECT doc_id, stn, tok AS term, count(*) AS tf FROM seg WHERE {P.legit('tok')} GROUP BY ALL), {_vocabulary(2)},
em AS (SELECT doc_id, stn, sum(tf * ln(beta)) FILTER (k = 0) AS e0, sum(tf * ln(beta)) FILTER (k = 1) AS e1 FROM cnt JOIN be USING (term) GROUP BY doc_id, stn),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stn) AS t, exp(e0 - greatest(e0, e1)) AS x0, exp(e1 - greatest(e0, e1)) AS x1, greatest(e0, e1) AS m FROM em),
f(doc_id, t, p0, p1, ll) AS (
  SELECT doc_id, t, x0 / (x0 + x1), x1 / (x0 + x1), ln((x0 + x1) / 2) + m FROM s WHERE t = 1
  UNION ALL
  SELECT doc_id, t, u0 / (u0 + u1), u1 / (u0 + u1), ll + ln(u0 + u1) + m
  FROM (SELECT s.doc_id, s.t, (0.15 + 0.7 * f.p0) * x0 AS u0, (0.15 + 0.7 * f.p1) * x1 AS u1, f.ll, m FROM f JOIN s ON s.doc_id = f.doc_id AND s.t = f.t + 1))
SELECT doc_id, max(t) AS sentences, round(min(ll) / max(t), 6) AS per_sentence FROM f GROUP BY doc_id""")
def htmm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of the documents' sentences by the forward recursion, from fixed topics."""
    from corpuloom.operators import sequence_topics as H
    from corpuloom.plans.model_queries import sentences

    docs, size = sentences(spark, sf_dir)
    # Remainders stand for the terms, so the model doesn't grow with the vocabulary.
    rest = F.transform("stns", lambda s: F.struct(F.transform(s["idx"], lambda i: (i % 7).cast("int")).alias("idx"), s["tf"].alias("tf")))
    got = H.likelihoods(spark, docs.withColumn("stns", rest), H.Model(np.log(_chances(2, size)), epsilon=0.3)).where("sentences > 0")
    return got.select("doc_id", "sentences", r6(F.col("ll") / F.col("sentences"), "per_sentence"))


@query("""WITH p AS (SELECT s_suppkey AS s, n_nationkey AS n, s_acctbal / 5000 AS a0, s_nationkey / 10.0 AS a1, n_regionkey / 2.0 AS b0, n_nationkey / 20.0 AS b1 FROM supplier CROSS JOIN nation),
d AS (SELECT *, a0 * b0 + a1 * b1 AS dot FROM p)
SELECT s, n, round(dot, 6) AS linear, round((0.5 * dot + 1)^3, 6) AS poly, round(exp(-0.5 * ((a0 - b0)^2 + (a1 - b1)^2)), 6) AS rbf, round(tanh(0.5 * dot + 1), 6) AS sigmoid FROM d""")
def kernel_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels of suppliers against the nations."""
    from corpuloom.operators.kernel import gram
    from corpuloom.session import ship

    ship(spark)
    nations = P.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") / 2).alias("b0"), (F.col("n_nationkey") / 20).alias("b1")).toPandas()  # one row per nation

    def run(parts):
        for pdf in parts:
            if len(pdf):
                a, b = pdf[["a0", "a1"]].to_numpy(float), nations[["b0", "b1"]].to_numpy(float)
                out = {k: gram(a, b, k, gamma=0.5, coef0=1.0, degree=3).ravel() for k in ("linear", "poly", "rbf", "sigmoid")}
                yield pd.DataFrame({"s": np.repeat(pdf["s"].to_numpy(), len(b)), "n": np.tile(nations["n_nationkey"].to_numpy(), len(a)), **out})

    rows = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_acctbal") / 5000).alias("a0"), (F.col("s_nationkey") / 10).alias("a1"))
    out = rows.mapInPandas(run, "s long, n long, linear double, poly double, rbf double, sigmoid double")
    return out.select("s", "n", *[r6(k, k) for k in ("linear", "poly", "rbf", "sigmoid")])


_SOFT = "CASE WHEN {x} > 0.01 THEN {x} - 0.005 WHEN {x} > 0 THEN {x} * {x} / 0.02 ELSE 0 END"


@query(f"""WITH r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE -1 END AS y, l_extendedprice / 10000 AS t, l_linenumber % 3 AS c FROM lineitem),
z AS (SELECT *, 0.3 * a - 0.2 * b + 0.1 AS z, [0.3 * a - 0.2 * b + 0.1, -0.1 * a + 0.4 * b, 0.2 * a + 0.1 * b - 0.3] AS zs FROM r),
x AS (SELECT *, 1 - y * z AS gap, abs(z - t) - 0.1 AS far, zs[c + 1] AS own, greatest(CASE WHEN c <> 0 THEN zs[1] ELSE -1e9 END, CASE WHEN c <> 1 THEN zs[2] ELSE -1e9 END, CASE WHEN c <> 2 THEN zs[3] ELSE -1e9 END) AS best FROM z),
l AS (SELECT unnest(['logistic', 'hinge', 'squared_hinge', 'epsilon', 'squared_epsilon', 'multinomial', 'crammer_singer']) AS loss,
  unnest([ln(1 + exp(-y * z)), {_SOFT.format(x='gap')}, greatest(0, gap)^2, {_SOFT.format(x='far')}, greatest(0, far)^2, ln(exp(zs[1]) + exp(zs[2]) + exp(zs[3])) - own, greatest(0, best + 1 - own)^2]) AS value FROM x)
SELECT loss, round(avg(value), 6) AS value FROM l GROUP BY loss""")
def linear_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean losses of fixed weights, as the optimizers' objective gives them."""
    from corpuloom.operators import linear as L
    from corpuloom.session import ship

    ship(spark)
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.array(F.lit(0), F.lit(1)).alias("idx"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("val"), F.lit(1.0).alias("weight"),
        F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0).alias("sign"), (F.col("l_extendedprice") / 10000).alias("number"), (F.col("l_linenumber") % 3).cast("double").alias("place"),
    ).cache()
    n, one = rows.count(), np.array([[0.3, -0.2, 0.1]])
    three = np.array([[0.3, -0.2, 0.1], [-0.1, 0.4, 0.0], [0.2, 0.1, -0.3]])
    out = []
    for loss in L.LOSSES:
        w = three if loss in ("multinomial", "crammer_singer") else one
        y = "number" if loss in L.REGRESSION else "place" if len(w) > 1 else "sign"
        value, _ = L.objective(rows.withColumnRenamed(y, "y").select("y", "idx", "val", "weight"), w.shape, loss, 1.0, 0.1)(w.ravel())
        out.append((loss, round(float(value - 0.5 * (w * w).sum()) / n, 6)))
    rows.unpersist()
    return spark.createDataFrame(out, "loss string, value double")
