"""Transductive classification on a graph of similar documents (Gaussian fields).

Labelled documents keep their labels; the value of an unlabelled one is
    eta * (alpha sum over labelled neighbours w y + beta sum over unlabelled ones w f) / (alpha sum w + beta sum w) + (1 - eta) * prior,
its prior being what a classifier of the labelled ones says. Weights are exp(dot of the terms' vectors - symmetric
KL divergence of the topics / number of topics), the same in both directions. Times the sums below the line this is a
symmetric, diagonally dominant system, solved by preconditioned conjugate gradients: an iteration is one join of the
edges with the directions, written, and one aggregate, from which all of the iteration's scalars follow. Nothing that
grows with the documents comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions import arrays as A
from corpuloom.operators import linear as L
from corpuloom.operators.similarity import nearest_class
from corpuloom.session import Scratch


def similarity(dot: Column, topics: Column | None = None, other: Column | None = None) -> Column:
    """exp(dot - symmetric KL / topics); documents without topics count by their terms alone."""
    if topics is None or other is None:
        return F.exp(dot)
    return F.exp(dot - F.coalesce(A.kl_symmetric(topics, other) / F.size(topics), F.lit(0.0)))


def weighted(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """src, dst, w of candidate pairs (src, dst), once per pair and direction, without loops. documents: id, vector, topics (may be null)."""
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near, far = (documents.select(F.col("id").alias(f"{n}_id"), F.col("vector").alias(f"{n}_vector"), F.col("topics").alias(f"{n}_topics")) for n in ("n", "f"))
    joined = both.join(near, F.col("src") == F.col("n_id")).join(far, F.col("dst") == F.col("f_id"))
    return joined.select("src", "dst", similarity(A.dot(F.col("n_vector"), F.col("f_vector")), F.col("n_topics"), F.col("f_topics")).alias("w"))


def solve(spark: SparkSession, edges: DataFrame, state: DataFrame, alpha: float = 1.0, beta: float = 0.1, eta: float = 0.7, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """id, f, labelled: the fixed point. edges: src, dst, w, the same in both directions; state: id, y (of the labelled), prior, labelled.

    Unlabelled nodes without a neighbour have their prior.
    """
    scratch = Scratch(spark, "fields")
    state = scratch.table(state.select("id", F.when(F.col("labelled"), F.col("y").cast("double")).alias("y"), F.col("prior").cast("double").alias("prior"), "labelled"), "nodes")
    edges = scratch.table(edges.select("src", "dst", "w"), "edges")
    far = state.select(F.col("id").alias("dst"), "y", "labelled")
    met = edges.join(far, "dst").groupBy(F.col("src").alias("n_id")).agg(
        F.coalesce(F.sum(F.when(F.col("labelled"), alpha * F.col("w") * F.col("y"))), F.lit(0.0)).alias("pull"), F.sum(F.col("w") * F.when(F.col("labelled"), alpha).otherwise(beta)).alias("d")
    )
    free = state.where(~F.col("labelled")).join(met, F.col("id") == F.col("n_id")).where("d > 0")
    # the first residual is b - A x at x = prior, direction 0; edges between unlabelled nodes only from here on
    free = scratch.table(free.select("id", "d", (eta * F.col("pull") + (1 - eta) * F.col("d") * F.col("prior")).alias("b"), F.col("prior").alias("x")), "free")
    inner = edges.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi")
    inner = scratch.table(inner, "inner")

    def times(table: DataFrame, column: str) -> DataFrame:
        """table with q, the matrix times a column."""
        sums = inner.join(table.select(F.col("id").alias("dst"), F.col(column).alias("_v")), "dst").groupBy(F.col("src").alias("_n")).agg(F.sum(F.col("w") * F.col("_v")).alias("_s"))
        return table.join(sums, F.col("id") == F.col("_n"), "left").withColumn("q", F.col("d") * F.col(column) - eta * beta * F.coalesce("_s", F.lit(0.0))).drop("_n", "_s")

    begun = times(free, "x").select("id", "d", "x", (F.col("b") - F.col("q")).alias("r"))
    now = scratch.table(begun.withColumn("p", F.col("r") / F.col("d")), "step-0")
    scale = float(free.agg(F.sum(F.col("b") ** 2 / F.col("d"))).first()[0] or 0.0)
    rz = float(now.agg(F.sum(F.col("r") ** 2 / F.col("d"))).first()[0] or 0.0)
    last = "step-0"
    for k in range(1, most + 1):
        if rz <= tolerance**2 * max(scale, 1e-300):
            break
        name = f"step-{k}"
        moved = scratch.table(times(now, "p"), name)
        scratch.drop(last)
        sums = moved.agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("r") * F.col("q") / F.col("d")).alias("rq"), F.sum(F.col("q") ** 2 / F.col("d")).alias("qq")).first()
        if not sums["pq"] or sums["pq"] <= 0:
            break
        step = rz / sums["pq"]
        after = max(0.0, rz - 2 * step * sums["rq"] + step * step * sums["qq"])
        r = F.col("r") - step * F.col("q")
        now = moved.select("id", "d", (F.col("x") + step * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + after / rz * F.col("p")).alias("p"))
        rz, last = after, name
    found = now.select(F.col("id").alias("_id"), F.col("x").alias("_x"))
    return state.join(found, F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("labelled"), F.col("y")).otherwise(F.coalesce("_x", "prior")).alias("f"), "labelled")


def learn(
    spark: SparkSession, documents: DataFrame, pairs: DataFrame, features: int, c: float = 1.0, shares: dict | None = None, **rates
) -> DataFrame:
    """id, f, label of documents (id, y null where unlabelled, idx, val, vector, topics) of two classes, 0 and 1, on a graph of candidate pairs.

    The prior of an unlabelled document is its probability of class 1 by a logistic model of the labelled ones, and the label
    the class whose value is nearest to f, divided by the class's share.
    """
    known = documents.where(F.col("y").isNotNull())
    model = L.fit(spark, known.select("y", "idx", "val"), features, "logistic", c, solver="newton", tolerance=1e-8)
    prior = L.predict(spark, documents, model).select(F.col("id").alias("_pid"), F.col("probability")[1].alias("prior"))
    state = documents.join(prior, F.col("id") == F.col("_pid")).select("id", "y", "prior", F.col("y").isNotNull().alias("labelled"))
    if shares is None:
        row = known.groupBy("y").count().collect()  # two classes
        total = sum(r["count"] for r in row)
        shares = {int(r["y"]): r["count"] / total for r in row}
    fields = solve(spark, weighted(pairs, documents), state, **rates)
    return nearest_class(fields, shares).select("id", "f", "label")


def objective_gap(edges: DataFrame, fields: DataFrame, state: DataFrame, alpha: float = 1.0, beta: float = 0.1, eta: float = 0.7) -> float:
    """By how much the values miss the fixed point, at most over the nodes."""
    from corpuloom.operators.similarity import propagation_step

    held = fields.select("id", "f").join(state.select("id", "prior", "labelled"), "id")
    return float(propagation_step(edges, held, alpha, beta, eta).agg(F.max("delta")).first()[0] or 0.0)


__all__ = ["learn", "objective_gap", "similarity", "solve", "weighted"]
