"""Naive Bayes over term counts, supervised and semi-supervised, and classification figures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.functions.special import logsumexp
from corpuloom.operators.ranking import global_rank
from corpuloom.operators.topics import MOST_CELLS, summed_arrays
from corpuloom.session import Scratch, ship

POSTINGS = 1 << 20  # rows of terms and documents held at a time


def _classes(*rows: DataFrame) -> list:
    """The classes that rows have, in order."""
    return sorted({r["y"] for x in rows for r in x.select("y").where("y is not null").distinct().collect()})  # a row per class


def _exploded(classes: list, y: T.DataType, *names: str) -> Column:
    """Columns name0, name1, ... of the classes as rows of y and names."""
    return F.explode(F.array(*[F.struct(F.lit(c).cast(y).alias("y"), *[F.col(f"_{n}{i}").alias(n) for n in names]) for i, c in enumerate(classes)]))


def train(
    counts: DataFrame, weights: DataFrame, delta: float = 0.1, prior_delta: float = 0.0, presence: bool = False, classes: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """counts (doc_id, term, tf), weights (doc_id, y, q): a document's share of each class; classes: those of the weights, if known.

    Returns (y, log_prior): ln(sum q + prior_delta), not normalized; and (y, term, log_p):
    ln(delta + c) - ln(sum c + V delta) for terms seen in training, with a row of term null for
    those a class hasn't got.

    Classes lie side by side, so no row per class is made of the counts, and the sums per term are written once.
    """
    value = F.lit(1.0) if presence else F.col("tf").cast("double")
    classes = _classes(weights) if classes is None else classes
    kind = weights.schema["y"].dataType
    priors = weights.groupBy("y").agg(F.ln(F.sum("q") + prior_delta).alias("log_prior"))
    shares = weights.groupBy("doc_id").agg(*[F.sum(F.when(F.col("y") == c, F.col("q"))).alias(f"_q{i}") for i, c in enumerate(classes)])
    # Soft counts come from weights with every class, so all terms meet all classes.
    each = counts.join(shares.hint("shuffle_hash"), "doc_id").groupBy("term").agg(*[F.sum(value * F.col(f"_q{i}")).alias(f"_c{i}") for i in range(len(classes))])
    each = Scratch(counts.sparkSession, "nbsums").table(each, "terms")
    sums = each.select("term", _exploded(classes, kind, "c").alias("x")).select("x.y", "term", "x.c").where("c is not null")
    size = each.agg(F.count(F.lit(1)).alias("v"))
    totals = sums.groupBy("y").agg(F.sum("c").alias("total")).crossJoin(F.broadcast(size))
    denominators = totals.select("y", (F.ln(F.col("total") + F.col("v") * delta)).alias("log_total"))
    seen = sums.join(F.broadcast(denominators), "y").select("y", "term", (F.ln(F.lit(delta) + F.col("c")) - F.col("log_total")).alias("log_p"))  # a row per class
    unseen = denominators.select("y", F.lit(None).cast("string").alias("term"), (F.ln(F.lit(delta)) - F.col("log_total")).alias("log_p"))
    return priors, seen.unionByName(unseen)


def scores(counts: DataFrame, model: tuple[DataFrame, DataFrame], presence: bool = False) -> DataFrame:
    """doc_id, y, log_joint, posterior. Terms outside the training vocabulary don't count.

    Terms are joined once, all classes of a term in a row: a term's missing classes are filled from the class's default
    through the sum over its default and what seen terms differ from it.
    """
    priors, terms = model
    defaults = terms.where(F.col("term").isNull()).select("y", F.col("log_p").alias("default"))
    seen = terms.where(F.col("term").isNotNull())
    classes, kind = _classes(priors), priors.schema["y"].dataType
    places = range(len(classes))
    value = F.lit(1.0) if presence else F.col("tf").cast("double")
    lift = F.col("log_p") - F.col("default")
    known = seen.join(F.broadcast(defaults), "y").groupBy("term").agg(*[F.sum(F.when(F.col("y") == c, lift)).alias(f"_w{i}") for i, c in enumerate(classes)])
    inside = counts.join(known.hint("shuffle_hash"), "term")
    sums = inside.groupBy("doc_id").agg(F.sum(value).alias("len"), *[F.sum(value * F.col(f"_w{i}")).alias(f"_lift{i}") for i in places])
    base = counts.select("doc_id").distinct().join(sums.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "len", _exploded(classes, kind, "lift").alias("x"))
    joint = base.select("doc_id", "len", "x.y", "x.lift").join(F.broadcast(priors.join(defaults, "y")), "y").select(  # a row per class
        "doc_id", "y", (F.col("log_prior") + F.coalesce("len", F.lit(0.0)) * F.col("default") + F.coalesce("lift", F.lit(0.0))).alias("log_joint")
    )
    per = Window.partitionBy("doc_id")
    top = F.max("log_joint").over(per)
    norm = top + F.ln(F.sum(F.exp(F.col("log_joint") - F.col("_m"))).over(per))
    return joint.withColumn("_m", top).withColumn("posterior", F.exp(F.col("log_joint") - norm)).drop("_m")


def predict(scored: DataFrame) -> DataFrame:
    """doc_id, pred: the class with the greatest joint, ties to the smaller one."""
    best = F.max(F.struct("log_joint", (-F.col("y")).alias("m")))
    return scored.groupBy("doc_id").agg(best.alias("b")).select("doc_id", (-F.col("b.m")).alias("pred"))


def em_step(counts: DataFrame, labelled: DataFrame, model: tuple[DataFrame, DataFrame], delta: float = 0.1, prior_delta: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Posteriors of the unlabelled documents, then counts and soft counts together."""
    hard = labelled.select("doc_id", "y", F.lit(1.0).alias("q"))
    open_counts = counts.join(labelled.select("doc_id"), "doc_id", "left_anti")
    soft = scores(open_counts, model).select("doc_id", "y", F.col("posterior").alias("q"))
    return train(counts, hard.unionByName(soft), delta, prior_delta, classes=_classes(hard, model[0]))


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of term, at, tf in order of the terms as blocks of whole terms: where terms begin, documents' places, counts."""
    held: list[np.ndarray] = []
    last, n, goal = None, 0, size

    def block(x: np.ndarray) -> pa.RecordBatch:
        parts = [np.flatnonzero(x[:, 0]).astype("<i4"), x[:, 1].astype("<i4"), x[:, 2].astype("<f8")]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["begins", "at", "tf"])

    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column("term")
        new = np.ones(batch.num_rows, np.int64)
        new[0] = term[0].as_py() != last
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        last = term[len(term) - 1].as_py()
        held.append(np.column_stack([new, batch.column("at").to_numpy(), batch.column("tf").to_numpy()]))
        n += len(new)
        if n >= goal:
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(rows[:, 0])[-1])
            if cut:
                yield block(rows[:cut])
            held, n = [rows[cut:]], len(rows) - cut
            goal = max(size, 2 * n)
    if n:
        yield block(np.concatenate(held))


def _lifts(batches: Iterator[pa.RecordBatch], shared, delta: float) -> Iterator[pa.RecordBatch]:
    """Per class and document what its terms' logarithms are above the default, and (at -1) its words that a document with a class has."""
    q: np.ndarray = shared.value  # classes x documents
    sums, words = np.zeros_like(q), np.zeros(q.shape[1])
    has = q.sum(0) > 0
    for batch in batches:
        for i in range(batch.num_rows):
            begins, at, tf = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("begins", "<i4"), ("at", "<i4"), ("tf", "<f8")))
            times = np.diff(np.append(begins, len(at)))
            for weights, out in zip(q, sums):
                lift = np.log1p(np.add.reduceat(tf * weights[at], begins) / delta)
                np.add.at(out, at, tf * np.repeat(lift, times))
            known = np.repeat(np.logical_or.reduceat(has[at], begins), times)
            np.add.at(words, at[known], tf[known])
            yield _arrays([-2], np.array([[float(np.logical_or.reduceat(has[at], begins).sum())]]))
    yield _arrays([-1, *range(len(q))], np.vstack([words, sums]))


def _arrays(keys: list[int], x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32), x.ravel())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["k", "v"])


def _placed(batches: Iterator[pa.RecordBatch], shared, classes: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for c, row in zip(classes, shared.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array([c] * len(ids), pa.int64()), pa.array(row[batch.column("at").to_numpy()])], ["doc_id", "y", "x"])


def settled(
    spark: SparkSession, counts: DataFrame, labelled: DataFrame, most: int = 50, tolerance: float = 1e-5, delta: float = 0.1, prior_delta: float = 0.1, history: list | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """EM as em_step() has it: (doc_id, y, q), the weights that the last model is made of, and (doc_id, y, log_joint) by that model.
    Classes are integers. None where documents x classes are too many to broadcast, or no labelled document has a term.

    Terms' rows lie in blocks of whole terms, made once. A round is one pass over them, for what a model says of a term follows
    from its own rows and the documents' weights: documents x classes go out and come back, and nothing as long as the vocabulary.
    """
    ship(spark)
    scratch = Scratch(spark, "nbem")
    docs = scratch.table(global_rank(counts.select("doc_id").distinct(), ["doc_id"], "at"), "docs")
    n = docs.count()
    marked = labelled.join(docs, "doc_id").groupBy("at", "y").agg(F.count(F.lit(1)).alias("q")).toArrow()  # as many as documents at most
    known = marked.filter(pc.is_valid(marked.column("y")))
    classes = sorted(set(known.column("y").to_pylist()))  # others have no term to know them by
    if not classes or n * len(classes) > MOST_CELLS or n >= 1 << 31:
        return None
    given = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    hard = np.zeros((len(classes), n))
    hard[np.searchsorted(classes, known.column("y").to_numpy()), known.column("at").to_numpy()] = known.column("q").to_numpy()
    is_open = np.ones(n, bool)
    is_open[marked.column("at").to_numpy()] = False
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = counts.join(docs.hint("shuffle_hash"), "doc_id").select("term", "at", F.col("tf").cast("long").alias("tf"))
    packed = rows.repartition(parts, "term").sortWithinPartitions("term").mapInArrow(partial(_packed, size=POSTINGS), "begins binary, at binary, tf binary")
    blocks = scratch.table(packed, "terms").coalesce(2 * spark.sparkContext.defaultParallelism)

    def joints(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)
        sums = summed_arrays(blocks.mapInArrow(partial(_lifts, shared=shared, delta=delta), "k long, v array<double>"), "k", "v", (len(q) + 1) * n)
        shared.unpersist()
        log_total = np.log(q @ lengths + sums[-2][0] * delta)
        prior = np.log(np.array([given[c] for c in classes]) + q[:, is_open].sum(1) + prior_delta)
        return prior[:, None] + sums[-1] * (np.log(delta) - log_total)[:, None] + np.stack([sums[k] for k in range(len(q))])

    per = scratch.table(counts.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("len")), "lengths")
    lens = docs.join(per, "doc_id").select("at", "len").toArrow()  # a number per document
    lengths = np.zeros(n)
    lengths[lens.column("at").to_numpy()] = lens.column("len").to_numpy()
    q, last = hard, None
    joint = joints(q)
    for _ in range(most):
        q = np.where(is_open, np.exp(joint - logsumexp(joint, axis=0)), hard)
        joint = joints(q)
        likelihood = float(logsumexp(joint, axis=0).sum())
        if history is not None:
            history.append(likelihood)
        if last is not None and abs((likelihood - last) / last) < tolerance:
            break
        last = likelihood
    out = lambda x, name: docs.mapInArrow(
        partial(_placed, shared=spark.sparkContext.broadcast(x), classes=classes), "doc_id long, y long, x double"
    ).select("doc_id", F.col("y").cast(labelled.schema["y"].dataType).alias("y"), F.col("x").alias(name))
    soft = out(q, "q").join(labelled.select("doc_id"), "doc_id", "left_anti")
    return labelled.select("doc_id", "y", F.lit(1.0).alias("q")).unionByName(soft), out(joint, "log_joint")


def semi_supervised(spark: SparkSession, counts: DataFrame, labelled: DataFrame, most: int = 50, tolerance: float = 1e-5, delta: float = 0.1, prior_delta: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """EM from the labelled documents on; stops when the unlabelled ones' likelihood settles."""
    scratch = Scratch(spark, "nbem")
    kept = lambda m, k: (scratch.table(m[0], f"priors-{k}"), scratch.table(m[1], f"terms-{k}"))
    done = settled(spark, counts, labelled, most, tolerance, delta, prior_delta)
    if done:
        return kept(train(counts, done[0], delta, prior_delta, classes=_classes(labelled)), most)
    hard = labelled.select("doc_id", "y", F.lit(1.0).alias("q"))
    model = kept(train(counts.join(labelled.select("doc_id"), "doc_id", "left_semi"), hard, delta, prior_delta), 0)
    last = None
    for k in range(1, most + 1):
        model = kept(em_step(counts, labelled, model, delta, prior_delta), k)
        joint = scores(counts, model)
        likelihood = joint.groupBy("doc_id").agg((F.max("log_joint") - F.ln(F.max("posterior"))).alias("l")).agg(F.sum("l")).first()[0]
        if last is not None and abs((likelihood - last) / last) < tolerance:
            break
        last = likelihood
    return model


# Figures. predictions: pred, y.


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("pred", "y").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(table: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """Per class precision, recall and F1 from (pred, y, n); a denominator of 0 gives 0. The smoothing is added to denominators."""
    rows = table.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("said"))
    columns = table.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("is"))
    right = table.where(F.col("pred") == F.col("y")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    joined = rows.join(columns, "c", "full_outer").join(right, "c", "left").na.fill(0, ["said", "is", "tp"])
    share = lambda a, b: F.when(b + smoothing > 0, a / (b + smoothing)).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("is"))
    return joined.select(F.col("c").alias("y"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def accuracy(table: DataFrame) -> DataFrame:
    """0 if there is one row or none."""
    n, right = F.sum("n"), F.coalesce(F.sum(F.when(F.col("pred") == F.col("y"), F.col("n"))), F.lit(0))
    return table.agg(F.when(n > 1, right / n).otherwise(F.lit(0.0)).alias("accuracy"))


def across_folds(figures: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return figures.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
