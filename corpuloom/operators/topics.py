"""Topic models by EM: two topics, pLSA (grouped too), variational LDA, Gibbs LDA.

A corpus is one row per document: doc_id, idx (array of term indices), tf (array of counts). What
the corpus-wide step needs (topics x vocabulary) is broadcast: its size is topics * vocabulary, is
checked, and doesn't grow with the documents. Each round is one pass over the documents in Arrow
batches, whose terms lie in one line, so that a step is a few operations on whole batches; partitions give their summed statistics, so what comes back is bounded by partitions *
topics * vocabulary and summed by an aggregation. Document state is written each round to the
shared folder, which cuts lineage, in the buckets in which the documents lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions.special import digamma, lgamma, logsumexp, trigamma
from corpuloom.session import Scratch, ship

MOST_CELLS = 50_000_000  # topics * vocabulary that may be broadcast
DOCS = 1024  # documents at a time
BUCKET_DOCS = 100_000  # documents of a task, which holds their states and gives one set of statistics


def corpus(counts: DataFrame) -> DataFrame:
    """(doc_id, idx, tf) rows to documents."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("tf").cast("double").alias("tf"))))
    return counts.groupBy("doc_id").agg(pairs.alias("p")).select("doc_id", F.col("p.idx").alias("idx"), F.col("p.tf").alias("tf"))


@dataclass
class Model:
    """Topics x vocabulary in real space, a background, and what a round needs besides."""

    beta: np.ndarray
    background: np.ndarray
    alpha: np.ndarray
    lam: float = 0.0
    history: list[float] = field(default_factory=list)
    smoothing: tuple[float, float] = (1.01, 1.01)  # alpha - 1 and beta - 1 are pseudo counts


def start(topics: int, vocabulary: int, seed: int = 1, alpha: float = 1.01, beta: float = 1.01, background: np.ndarray | None = None, lam: float = 0.0) -> Model:
    if topics * vocabulary > MOST_CELLS:
        raise ValueError(f"topics * vocabulary = {topics * vocabulary} is above {MOST_CELLS}")
    x = np.random.default_rng(seed).random((topics, vocabulary)) + 1e-2
    bg = np.full(vocabulary, 1 / vocabulary) if background is None else background
    return Model(x / x.sum(1)[:, None], bg, np.full(topics, alpha), lam, smoothing=(alpha, beta))


def first_theta(doc: int, topics: int, seed: int) -> np.ndarray:
    x = np.random.default_rng((seed, doc & 0xFFFFFFFF)).random(topics) + 0.1
    return x / x.sum()


# E-steps: (idx, tf, theta, model) -> new theta, statistics (topics x len(idx)), log-likelihood


def two_topic_estep(tf: np.ndarray, idx: np.ndarray, theta: np.ndarray, background: np.ndarray, lam: float) -> np.ndarray:
    own = (1 - lam) * theta[idx]
    return tf * own / (own + lam * background[idx])


def two_topic(idx: np.ndarray, tf: np.ndarray, background: np.ndarray, lam: float = 0.5, beta: float = 1.01, rounds: int = 50, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """One document's own distribution over the vocabulary against a background."""
    theta, history = np.full(len(background), 1 / len(background)), []
    for _ in range(rounds):
        s = two_topic_estep(tf, idx, theta, background, lam)
        theta = np.full(len(background), beta - 1)
        theta[idx] += s
        theta /= s.sum() + len(background) * (beta - 1)
        history.append(float(tf @ np.log((1 - lam) * theta[idx] + lam * background[idx])))
        if len(history) > 1 and abs((history[-1] - history[-2]) / history[-2]) < tolerance:
            break
    return theta, history


def plsa_estep(idx: np.ndarray, tf: np.ndarray, theta: np.ndarray, model: Model, prior: np.ndarray | None = None):
    """prior adds pseudo counts to the document's topics (a group's mean, say)."""
    b = model.beta[:, idx]
    mix = theta @ b
    noise = model.lam * model.background[idx]
    noise = noise / (noise + (1 - model.lam) * mix)
    stat = tf * (1 - noise) * theta[:, None] * b / mix
    new = stat.sum(1) + model.smoothing[0] - 1 + (prior if prior is not None else 0)
    new = new / new.sum()
    ll = float(tf @ np.log((1 - model.lam) * mix + model.lam * model.background[idx])) + (model.smoothing[0] - 1) * float(np.log(theta).sum())
    return new, stat, ll


@dataclass
class Tokens:
    """Terms of some documents in a line: their indices, counts and documents."""

    idx: np.ndarray
    tf: np.ndarray
    doc: np.ndarray
    n: int

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "Tokens":
        sizes = np.diff(batch.column("idx").offsets.to_numpy())
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        return cls(flat("idx").astype(np.int64), flat("tf").astype(float), np.repeat(np.arange(len(sizes)), sizes), len(sizes))

    def per_doc(self, x: np.ndarray) -> np.ndarray:
        """Sums of a number, or of a row of them, per term over each document."""
        return np.stack([np.bincount(self.doc, c, self.n) for c in x.T], 1) if x.ndim > 1 else np.bincount(self.doc, x, self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over each document of topics x terms, as documents x topics. The terms lie by document."""
        out = np.zeros((self.n, len(x)))
        if len(self.doc):
            begins = np.flatnonzero(np.diff(self.doc, prepend=-1))
            out[self.doc[begins]] = np.add.reduceat(x, begins, axis=1).T
        return out

    def add_to(self, stats: np.ndarray, x: np.ndarray) -> None:
        """Adds the terms' rows to the columns of topics x vocabulary."""
        for topic, row in enumerate(stats):
            row += np.bincount(self.idx, x[:, topic], len(row))

    def of_docs(self, keep: np.ndarray) -> "Tokens":
        """Those of the documents that are kept, which are numbered anew."""
        held = keep[self.doc]
        return Tokens(self.idx[held], self.tf[held], (np.cumsum(keep) - 1)[self.doc[held]], int(keep.sum()))


def plsa_batch(tokens: Tokens, theta: np.ndarray, model: Model, terms: np.ndarray, prior: np.ndarray | None = None):
    """plsa_estep() for documents at once. terms: beta with a row per term. Statistics have a row per token."""
    part = terms[tokens.idx] * theta[tokens.doc]
    mix = part.sum(1)
    noise = model.lam * model.background[tokens.idx]
    whole = noise + (1 - model.lam) * mix
    stat = part * (tokens.tf * (1 - noise / whole) / mix)[:, None]
    new = tokens.per_doc(stat) + model.smoothing[0] - 1 + (prior if prior is not None else 0)
    total = new.sum(1, keepdims=True)
    new = np.where(total > 0, new / np.where(total > 0, total, 1), theta)
    ll = tokens.per_doc(tokens.tf * np.log(whole)) + (model.smoothing[0] - 1) * np.log(theta).sum(1)
    return new, stat, ll


def lda_batch(tokens: Tokens, gamma: np.ndarray | None, model: Model, terms: np.ndarray, rounds: int = 20, tolerance: float = 1e-6):
    """Mean field for documents at once; gamma is the state, documents that have settled are left out. The bound is the log-likelihood."""
    k = len(model.alpha)
    if gamma is None:
        gamma = model.alpha + tokens.per_doc(tokens.tf)[:, None] / k
    gamma, live, now = gamma.copy(), np.arange(tokens.n), tokens
    whole = held = np.ascontiguousarray(terms[tokens.idx].T)  # a row per topic: gathered once, not in each round

    def shares(g: np.ndarray, t: Tokens, chances: np.ndarray):
        e = digamma(g)
        top = e.max(1, keepdims=True)
        own = np.ascontiguousarray(np.exp(e - top).T)
        part = np.take(own, t.doc, axis=1)
        part *= chances
        return part, part.sum(0), e, top[:, 0]

    for _ in range(rounds):
        part, norm, *_ = shares(gamma[live], now, held)
        part *= now.tf / norm
        new = model.alpha + now.sums(part)
        stay = np.abs(new - gamma[live]).mean(1) >= tolerance
        gamma[live] = new
        if not stay.any():
            break
        if not stay.all():
            held = held[:, stay[now.doc]]
            live, now = live[stay], now.of_docs(stay)
    part, norm, e, top = shares(gamma, tokens, whole)
    phi = (part / norm).T
    total = gamma.sum(1)
    elog = e - digamma(total)[:, None]
    # with phi at its best, a term's share of the bound is the logarithm of its normalizer
    words = tokens.per_doc(tokens.tf * (np.log(norm) + top[tokens.doc])) - tokens.per_doc(tokens.tf) * digamma(total)
    bound = (
        lgamma(model.alpha.sum()) - lgamma(model.alpha).sum() + ((model.alpha - 1) * elog).sum(1) + words
        - lgamma(total) + lgamma(gamma).sum(1) - ((gamma - 1) * elog).sum(1)
    )
    return gamma, phi * tokens.tf[:, None], bound, elog


def newton_alpha(alpha: np.ndarray, elog: np.ndarray, docs: int, damping: float = 0.001, rounds: int = 20) -> np.ndarray:
    """Vector alpha by damped Newton steps on sum over documents of E ln theta."""
    for _ in range(rounds):
        g = docs * (digamma(alpha.sum()) - digamma(alpha)) + elog
        h = -docs * trigamma(alpha)
        z = docs * trigamma(alpha.sum())
        c = (g / h).sum() / (1 / z + (1 / h).sum())
        step = damping * (g - c) / h
        alpha = np.maximum(alpha - step, 1e-3)
        if np.abs(step).max() < 1e-6:
            break
    return alpha


def plsa_step(counts: DataFrame, theta: DataFrame, beta: DataFrame, background: DataFrame, lam: float, smoothing: float) -> DataFrame:
    """One EM step as joins and aggregations: counts (doc_id, term, tf), theta (doc_id, k, theta), beta (term, k, beta),
    background (term, p) -> k, term, p. For vocabularies too large to broadcast; fit() is the fast way.

    Topics lie side by side in a row, so counts are shuffled twice, by document and by term, and no row per topic is made of them."""
    from pyspark.sql import Window

    ks = sorted(r["k"] for r in theta.select("k").distinct().collect())  # topics
    places = range(len(ks))
    wide = lambda rows, key, value, name: rows.groupBy(key).agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(f"{name}{i}") for i, k in enumerate(ks)])
    terms = wide(beta, "term", "beta", "_b").join(background, "term")
    both = counts.join(wide(theta, "doc_id", "theta", "_t").hint("shuffle_hash"), "doc_id").join(terms.hint("shuffle_hash"), "term")
    part = [F.col(f"_t{i}") * F.col(f"_b{i}") for i in places]  # null where the document or the term lacks the topic
    both = both.withColumn("s", sum((F.coalesce(x, F.lit(0.0)) for x in part), F.lit(0.0)))
    noise = lam * F.col("p") / (lam * F.col("p") + (1 - lam) * F.col("s"))
    sums = both.groupBy("term").agg(*[F.sum(F.col("tf") * (1 - noise) * x / F.col("s")).alias(f"_e{i}") for i, x in enumerate(part)])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast(theta.schema["k"].dataType).alias("k"), F.col(f"_e{i}").alias("e")) for i, k in enumerate(ks)]))
    stat = sums.select("term", each.alias("x")).where("x.e is not null").select("x.k", "term", (F.col("x.e") + smoothing).alias("e"))
    return stat.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("k"))).drop("e")


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The lists of the named rows, all of one length."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _states(batch: pa.RecordBatch, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a list in the column, and the lists."""
    have = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
    return have, _matrix(batch.column(name), np.flatnonzero(have), width)


def _round(batches: Iterator[pa.RecordBatch], kind: str, shared, seed: int, has_state: bool) -> Iterator[pa.RecordBatch]:
    """A pass over documents: rows with doc_id are documents' states, rows without are a partition's statistics of one topic."""
    model: Model = shared.value
    k, v = model.beta.shape
    terms = np.ascontiguousarray(model.beta.T)
    stats, elog = np.zeros((k, v)), np.zeros(k)
    for whole in batches:
        for at in range(0, whole.num_rows, DOCS):
            batch = whole.slice(at, DOCS)
            tokens, ids = Tokens.of(batch), batch.column("doc_id").to_pylist()
            if kind == "lda":
                state = _states(batch, "state", k)[1] if has_state else None
                state, stat, ll, e = lda_batch(tokens, state, model, terms)
                elog += e.sum(0)
            else:
                state = _states(batch, "state", k)[1] if has_state else np.array([first_theta(d, k, seed) for d in ids])
                prior = np.zeros((len(ids), k))
                if "prior" in batch.schema.names:
                    have, given = _states(batch, "prior", k)
                    prior[have] = given
                state, stat, ll = plsa_batch(tokens, state, model, terms, prior)
            tokens.add_to(stats, stat)
            yield _rows(ids, state, ll)
    for topic in range(k):
        yield _rows([None], stats[topic : topic + 1], elog[topic : topic + 1], topic)


def _rows(ids: list, states: np.ndarray, lls: np.ndarray, topic: int | None = None) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(0, states.size + 1, max(1, states.shape[1])).astype(np.int32), np.ascontiguousarray(states).ravel())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([topic] * len(ids), pa.int32()), lists, pa.array(lls, pa.float64())], ["doc_id", "topic", "state", "ll"]
    )


_SCHEMA = "doc_id long, topic int, state array<double>, ll double"


def fit(
    spark: SparkSession, docs: DataFrame, model: Model, kind: str = "plsa", rounds: int = 20, tolerance: float = 1e-4, seed: int = 1,
    word_prior: np.ndarray | None = None, groups: DataFrame | None = None, learn_alpha: bool = False,
) -> tuple[Model, DataFrame]:
    """EM until the relative change of the likelihood falls below the tolerance.

    word_prior (topics x vocabulary) adds seed-word pseudo counts each round; groups (doc_id, group)
    gives documents of a group their mean topics as a prior. Returns the model and (doc_id, theta).
    """
    if kind not in ("plsa", "lda"):
        raise ValueError("kind must be plsa or lda")
    ship(spark)
    scratch = Scratch(spark, f"topics-{kind}")
    docs = scratch.table(docs, "docs")
    count = docs.count()
    buckets = max(spark.sparkContext.defaultParallelism, -(-count // BUCKET_DOCS))
    # Documents and their states lie in the same buckets, so a round shuffles neither.
    docs = scratch.bucketed(docs.repartition(buckets, "doc_id"), "documents", "doc_id", buckets)
    scratch.drop("docs")
    state: DataFrame | None = None
    for r in range(rounds):
        source = docs
        if state is not None:
            source = docs.join(state.select("doc_id", "state").hint("shuffle_hash"), "doc_id")
            if groups is not None:
                mean = (
                    state.join(groups, "doc_id").select("group", F.posexplode("state").alias("k", "x")).groupBy("group", "k").agg(F.avg("x").alias("x"))
                    .groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("prior"))
                )
                source = source.join(groups.join(mean, "group").select("doc_id", "prior"), "doc_id", "left")
        shared = spark.sparkContext.broadcast(model)
        made = source.mapInArrow(partial(_round, kind=kind, shared=shared, seed=seed, has_state=state is not None), _SCHEMA)
        out = scratch.bucketed(made.withColumn("of", F.col("topic").isNotNull().cast("int")), f"round-{r}", "doc_id", buckets, "of")
        stats, elog = _collect_topics(out.where("of = 1"), model.beta.shape)
        ll = out.where("of = 0").agg(F.sum("ll")).first()[0]
        stats += model.smoothing[1] - 1
        if word_prior is not None:
            stats += word_prior
        beta = np.maximum(stats, 1e-12)
        alpha = newton_alpha(model.alpha, elog, count) if kind == "lda" and learn_alpha else model.alpha
        model = Model(beta / beta.sum(1)[:, None], model.background, alpha, model.lam, [*model.history, ll], model.smoothing)
        if r:
            scratch.drop(f"round-{r - 1}")
        state = out.where("of = 0")
        shared.unpersist()
        if len(model.history) > 1 and abs((model.history[-1] - model.history[-2]) / model.history[-2]) < tolerance:
            break
    # Without the topics' rows: an expression over the documents' short arrays must not meet arrays of the vocabulary's size.
    state = scratch.table(state.select("doc_id", "state"), "theta")
    scratch.drop("documents", f"round-{r}")
    total = F.aggregate("state", F.lit(0.0), lambda s, x: s + x)
    return model, state.select("doc_id", F.transform("state", lambda x: x / total).alias("theta"))


def _added(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.asarray(v.values, float)
            sums[k] = sums[k] + x if k in sums else x.copy()
    if sums:
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sums.values())]).astype(np.int32), np.concatenate(list(sums.values())))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), lists], names)


def summed_arrays(rows: DataFrame, key: str, value: str, cells: int, most: int = 16) -> dict[int, np.ndarray]:
    """Per key the sum of its arrays, of ``cells`` numbers over all keys.

    Each partition of an E-step gives one array per key. They are dealt over ``most`` tasks or fewer, added there,
    and only those tasks' sums come to the driver: a few times the model's size, however many partitions
    there were.
    """
    fan = max(1, min(most, MOST_CELLS // 4 // max(cells, 1)))
    salted = rows.select(F.col(key).cast("long").alias("k"), F.col(value).alias("v"), (F.spark_partition_id() % fan).alias("s"))
    parts = salted.repartition(fan, "k", "s").select("k", "v").mapInArrow(partial(_added, names=["k", "v"]), "k long, v array<double>")
    out: dict[int, np.ndarray] = {}
    for batch in parts.toArrow().to_batches():
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.asarray(v.values, float)
            out[k] = out[k] + x if k in out else x.copy()
    return out


def _collect_topics(out: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over partitions: statistics, and the rows' ll column as one more number per topic."""
    rows = out.where(F.col("doc_id").isNull()).select("topic", F.concat("state", F.array("ll")).alias("x"))
    stats = np.zeros((shape[0], shape[1] + 1))
    for k, x in summed_arrays(rows, "topic", "x", stats.size).items():
        stats[k] = x
    return stats[:, :-1], stats[:, -1]


def _inferred(batches, kind: str, shared, rounds: int, seed: int):
    model: Model = shared.value
    k, terms = len(model.beta), np.ascontiguousarray(model.beta.T)
    for whole in batches:
        for at in range(0, whole.num_rows, DOCS):
            batch = whole.slice(at, DOCS)
            tokens, ids = Tokens.of(batch), batch.column("doc_id").to_pylist()
            if "beta" in batch.schema.names:
                terms = batch.column("beta").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                tokens.idx = np.arange(len(terms))
            if kind == "lda":
                gamma = lda_batch(tokens, None, model, terms, rounds)[0]
                theta = gamma / gamma.sum(1, keepdims=True)
            else:
                theta = np.array([first_theta(d, k, seed) for d in ids])
                for _ in range(rounds):
                    theta = plsa_batch(tokens, theta, model, terms)[0]
            p = (1 - model.lam) * (terms[tokens.idx] * theta[tokens.doc]).sum(1) + (model.lam * model.background[tokens.idx] if model.lam else 0)
            ll, words = tokens.per_doc(tokens.tf * np.log(p)), tokens.per_doc(tokens.tf)
            lists = pa.ListArray.from_arrays(np.arange(0, theta.size + 1, k).astype(np.int32), theta.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(ll), pa.array(words)], ["doc_id", "theta", "ll", "words"])


def infer(spark: SparkSession, docs: DataFrame, model: Model, kind: str = "plsa", rounds: int = 30, seed: int = 1) -> DataFrame:
    """Held-out documents: doc_id, theta, ll, words.

    Documents may bring their terms' chances in a column beta (a term's topics after another's), where the vocabulary is too
    large to broadcast; the model then has topics without terms, and no background.
    """
    ship(spark)
    return docs.mapInArrow(partial(_inferred, kind=kind, shared=spark.sparkContext.broadcast(model), rounds=rounds, seed=seed), "doc_id long, theta array<double>, ll double, words double")


def perplexity(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """exp(-sum of likelihoods / words), and the mean likelihood of a document."""
    rows = scored.groupBy(*by) if by else scored
    return rows.agg(F.exp(-F.sum("ll") / F.sum("words")).alias("perplexity"), F.avg("ll").alias("avg_ll"), F.sum("words").alias("words"))


# Gibbs


def gibbs_sweep(words: np.ndarray, z: np.ndarray, doc_counts: np.ndarray, word_counts: np.ndarray, totals: np.ndarray, rng, frozen: bool = False) -> None:
    """Resample every token of a document in place; counts already hold the priors."""
    for n in rng.permutation(len(words)):
        w, old = words[n], z[n]
        doc_counts[old] -= 1
        if not frozen:
            word_counts[old, w] -= 1
            totals[old] -= 1
        p = doc_counts * word_counts[:, w] / totals
        c = np.cumsum(p)
        new = min(int(np.searchsorted(c, rng.random() * c[-1])), len(c) - 1)
        z[n] = new
        doc_counts[new] += 1
        if not frozen:
            word_counts[new, w] += 1
            totals[new] += 1


def sweep_all(words: np.ndarray, sizes: np.ndarray, z: np.ndarray, doc_counts: np.ndarray, term_counts: np.ndarray, totals: np.ndarray, rng) -> None:
    """gibbs_sweep() of many documents (their words in a line) in place: the n-th tokens in a random order of each, all at once.

    Within a document every token sees those before; tokens of one step don't see each other's moves in
    term_counts (a row per term), as tasks don't. Counts already hold the priors.
    """
    doc, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    shuffled = np.lexsort((rng.random(len(words)), doc))  # each document's tokens in a random order
    longest = np.argsort(-sizes, kind="stable")
    falling = -sizes[longest]
    for t in range(int(sizes.max()) if len(sizes) else 0):
        d = longest[: int(np.searchsorted(falling, -t, "left"))]
        at = shuffled[first[d] + t]
        w, old, row = words[at], z[at], np.arange(len(d))
        doc_counts[d, old] -= 1
        own, whole = term_counts[w], np.repeat(totals[None], len(d), 0)
        own[row, old] -= 1
        whole[row, old] -= 1
        c = np.cumsum(doc_counts[d] * own / whole, 1)
        new = np.minimum((c < (rng.random(len(d)) * c[:, -1])[:, None]).sum(1), c.shape[1] - 1)
        z[at] = new
        doc_counts[d, new] += 1
        np.subtract.at(term_counts, (w, old), 1)
        np.add.at(term_counts, (w, new), 1)
        totals += np.bincount(new, minlength=len(totals)) - np.bincount(old, minlength=len(totals))


_SWEPT = "doc_id long, idx array<int>, tf array<double>, z array<long>, topic int, stat array<double>"


def _swept(batches, shared, alpha: float, seed: int, sweep: int, vocabulary: int):
    """One sweep of a partition against the counts of the last one, which its own moves update (approximate distributed Gibbs).

    Rows with a topic are the partition's counts of its tokens.
    """
    base, topics = shared.value
    counts = np.ascontiguousarray(base.T) if base is not None else None
    totals = counts.sum(0) if base is not None else None
    stats = np.zeros((topics, vocabulary))
    names = [x.split(" ", 1)[0] for x in _SWEPT.split(", ")]
    for whole in batches:
        for start in range(0, whole.num_rows, 4 * DOCS):
            batch = whole.slice(start, 4 * DOCS)
            tokens, ids = Tokens.of(batch), batch.column("doc_id").to_pylist()
            times = tokens.tf.astype(int)
            words, sizes = np.repeat(tokens.idx, times), tokens.per_doc(times.astype(float)).astype(int)
            rng = np.random.default_rng((seed, sweep, (ids[0] or 0) & 0xFFFFFFFF))
            if counts is None or "z" not in batch.schema.names:
                z = rng.integers(0, topics, len(words))
            else:
                z = batch.column("z").flatten().to_numpy(zero_copy_only=False).copy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                own = np.bincount(doc * topics + z, minlength=len(sizes) * topics).reshape(-1, topics) + alpha
                sweep_all(words, sizes, z, own, counts, totals, rng)
            for k in range(topics):
                stats[k] += np.bincount(words[z == k], minlength=vocabulary)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), z.astype(np.int64))
            none = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("idx"), batch.column("tf"), lists, *none], names)
    for k in range(topics):
        null = [pa.nulls(1, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*null, pa.array([k], pa.int32()), pa.array([stats[k]], pa.list_(pa.float64()))], names)


def gibbs(
    spark: SparkSession, docs: DataFrame, topics: int, vocabulary: int, sweeps: int = 30, burn_in: float = 0.4, lag: int = 2,
    alpha: float = 0.5, beta: float = 0.1, seed: int = 1,
) -> tuple[Model, DataFrame]:
    """LDA by collapsed Gibbs sampling; samples after burn-in, every ``lag`` sweeps, are averaged."""
    ship(spark)
    if topics * vocabulary > MOST_CELLS:
        raise ValueError("topics * vocabulary is too large to broadcast")
    scratch = Scratch(spark, "gibbs")
    state = docs.select("doc_id", "idx", "tf")
    counts, kept, samples = None, np.zeros((topics, vocabulary)), 0
    history: list[float] = []
    for sweep in range(sweeps + 1):
        shared = spark.sparkContext.broadcast((counts, topics))
        swept = scratch.table(state.mapInArrow(partial(_swept, shared=shared, alpha=alpha, seed=seed, sweep=sweep, vocabulary=vocabulary), _SWEPT), f"sweep-{sweep}")
        if sweep:
            scratch.drop(f"sweep-{sweep - 1}")
        state = swept.where("topic is null").select("doc_id", "idx", "tf", "z")
        counts = np.full((topics, vocabulary), beta)
        for k, x in summed_arrays(swept.where("topic is not null"), "topic", "stat", counts.size).items():
            counts[k] += x
        shared.unpersist()
        if sweep > burn_in * sweeps and (sweep - int(burn_in * sweeps)) % lag == 0:
            kept += counts
            samples += 1
    total = kept if samples else counts
    model = Model(total / total.sum(1)[:, None], np.full(vocabulary, 1 / vocabulary), np.full(topics, alpha), history=history)
    shares = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: (F.size(F.filter("z", lambda t: t == k)) + alpha) / (F.size("z") + topics * alpha))
    return model, state.select("doc_id", shares.alias("theta"))


def hold_out_words(counts: DataFrame, share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Term counts split by a hash of document and term: what is learned from, what is scored."""
    from corpuloom.operators.users import hashed

    cut = hashed("doc_id", "idx", seed=seed) % 1000 < int(1000 * share)
    return counts.where(~cut), counts.where(cut)


def top_words(model: Model, terms: list[str], k: int = 10) -> list[tuple[int, int, str, float]]:
    """topic, rank, term, p"""
    out = []
    for topic, row in enumerate(model.beta):
        for rank, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:k], 1):
            out.append((topic, rank, terms[i], float(row[i])))
    return out


def by_owner(theta: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """An owner's topics: the L1-normalized sum of its documents'."""
    sums = theta.join(owners, "doc_id").select(key, F.posexplode("theta").alias("topic", "x")).groupBy(key, "topic").agg(F.sum("x").alias("x"))
    from pyspark.sql import Window

    return sums.withColumn("share", F.col("x") / F.sum("x").over(Window.partitionBy(key))).drop("x")

