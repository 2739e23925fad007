"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's words give their character 2- to 4-grams, word edges included, hashed to buckets. The
embeddings of all of them are averaged and a linear softmax scores the languages. Embeddings and
weights are trained by stochastic gradient descent in numpy, on at most ``most_rows`` labelled
rows chosen by a hash (equal quotas for the languages; what rare ones leave goes to the others).
Cross-validation over all of them sets the temperature of the softmax, and the score and the share of
known subwords below which a text is rejected: the ``reject`` quantiles (0.001) over texts that the
folds' models have not seen, so that about one clean text of a thousand may go by each, widened by a
margin that falls with their number. For prediction embeddings times weights make one table of bucket
scores, so each whole text costs one gather. Long texts go through in blocks.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected. If no
row can be learned from, so is everything. A null doc_id counts as the empty text in the fold. Rows
that repeat each other give one row each. Extra columns are kept by identify() and ignored by
predict(). No rows: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import ship

BUCKETS, DIM, GRAMS = 1 << 18, 16, (2, 3, 4)
UNKNOWN = "und"
FOLDS, MIXED = 3, 8
#: Unknown subwords that any text may have: a short one has few in all.
SPARE = 3
_BLOCK = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        out = out.copy()
        out[high] = [chr(p).isalpha() for p in points[high].tolist()]
    return out


def buckets(text: str):
    """Arrays of the buckets of a text's subwords, block by block; none if it has no letter."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and end < at + 2 * _BLOCK and text[end - 1].isalpha():
            end += 1
        points = np.frombuffer(("\x00" + text[at:end].lower() + "\x00").encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _is_letter(points)
        at = end
        if not letter.any():
            continue
        z = np.where(letter, points, 0).astype(np.uint64)
        found = []
        for n in GRAMS:
            if len(z) < n:
                continue
            size = len(z) - n + 1
            inner = letter[1 : 1 + size].copy() if n > 2 else letter[:size] | letter[1 : 1 + size]
            for k in range(2, n - 1):
                inner &= letter[k : k + size]
            h = np.full(size, np.uint64(n * 0x9E3779B1))
            for k in range(n):
                h = (h ^ z[k : k + size]) * np.uint64(0x100000001B3)
            found.append(((h >> np.uint64(20)) ^ h)[inner] & np.uint64(BUCKETS - 1))
        yield np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x (n + 1): embeddings (times weights where that is no wider), and whether training saw the bucket
    weights: np.ndarray | None  # embeddings to languages, where there are more languages than dimensions
    bias: np.ndarray
    temperature: float
    least: float  # score
    least_seen: float  # share of subwords that training saw

    def probabilities(self, text: str) -> tuple[np.ndarray, float] | None:
        """Of each language, and the share of the text's subwords that training saw."""
        total, n = np.zeros(self.table.shape[1]), 0
        for ids in buckets(text):
            n += len(ids)
            if len(ids) > BUCKETS:
                total += np.bincount(ids, minlength=BUCKETS) @ self.table
            else:
                total += self.table[ids].sum(0, dtype=np.float64)
        if not n:
            return None
        mean = total[:-1] / n
        return softmax(((mean if self.weights is None else mean @ self.weights) + self.bias) / self.temperature), known(total[-1], n)

    def score(self, p: np.ndarray, seen: float) -> float:
        """The best probability, less where too few subwords are known to trust it."""
        return float(p.max() * (min(1.0, seen / self.least_seen) if self.least_seen > 0 else 1.0))

    def rejects(self, p: np.ndarray, seen: float) -> bool:
        return bool(p.max() < self.least or seen < self.least_seen)


def known(n: float, total: float) -> float:
    """Share of known subwords, of which SPARE may be unknown."""
    return min(1.0, (n + min(n, SPARE)) / total)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def descend(examples: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of the buckets, weights and offsets of the languages, and which buckets were seen."""
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    W, b = rng.normal(0, 0.1, (DIM, n_langs)), np.zeros(n_langs)
    steps, total = 0, epochs * len(examples)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)).tolist():
            ids, counts, lang = examples[i]
            f = counts / counts.sum()
            x = f @ E[ids]
            g = softmax(x @ W + b)
            g[lang] -= 1
            eta = rate * (1 - steps / total)
            back = W @ g
            W -= eta * np.outer(x, g)
            b -= 0.1 * eta * g
            E[ids] -= (eta * DIM) * f[:, None] * back[None, :]
            steps += 1
    seen = np.zeros(BUCKETS, bool)  # other buckets hold nothing but their random start
    for ids, _, _ in examples:
        seen[ids] = True
    E[~seen] = 0
    return E, W, b, seen


def train(examples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 2.0, seed: int = 5, reject: float = 0.001) -> Model | None:
    """examples: buckets, their counts and the language. All are learned; each calibrates by the model of the other folds."""
    langs = sorted({e[2] for e in examples})
    if not langs:
        return None
    place = {x: i for i, x in enumerate(langs)}
    rows = [(i, c, place[lang]) for i, c, lang in examples]
    n, folds = len(rows), min(FOLDS, len(rows))
    logits, share, truth = np.zeros((n, len(langs))), np.zeros(n), np.array([r[2] for r in rows])
    for k in range(folds if n > 1 else 0):
        E, W, b, seen = descend([r for j, r in enumerate(rows) if j % folds != k], len(langs), epochs, rate, seed)
        for j in range(k, n, folds):
            ids, c, _ = rows[j]
            logits[j] = (c / c.sum()) @ E[ids] @ W + b
            share[j] = known(c[seen[ids]].sum(), c.sum())

    def scores(t: float, z: np.ndarray = logits) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1)[:, None]

    grid = [2 ** (k / 4) for k in range(-12, 17)]
    temperature = min(grid, key=lambda t: -np.log(scores(t)[np.arange(n), truth] + 1e-12).sum())
    p = scores(temperature)
    right = p.max(1)[p.argmax(1) == truth]
    # Reject what lies below what all but a share ``reject`` of the calibrating texts reach, with a margin. Even mixtures
    # of two languages calibrate the score too, so that a clean text in two languages stays. Fewer texts widen the
    # margins, by a power and as if two more texts knew half of their subwords.
    margin = 1 + 10 / np.sqrt(n)
    for k in range(folds):
        at = np.arange(k, n, folds)
        for by in range(1, min(MIXED + 1, len(at))):
            other = np.roll(at, by)
            differ = truth[at] != truth[other]
            right = np.append(right, scores(temperature, (logits[at] + logits[other])[differ] / 2).max(1))
    least = float(np.quantile(right, reject)) ** margin if len(right) else 0.0
    least_seen = ((n * float(np.quantile(share, reject)) + 1) / (n + 2)) ** (2 + margin)
    E, W, b, seen = descend(rows, len(langs), epochs, rate, seed)
    wide = len(langs) > DIM
    return Model(langs, np.hstack([E if wide else E @ W, seen[:, None]]).astype(np.float32), W if wide else None, b, temperature, least, least_seen)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _featured(batches):
    for batch in K.bounded(batches):
        rows: list[list] = [[], [], []]
        for lang, raw in zip(batch.column("lang").to_pylist(), K.texts(batch.column("text"))):
            found = list(buckets(raw.decode()))
            if found:
                ids, counts = np.unique(np.concatenate(found), return_counts=True)
                for column, value in zip(rows, (lang, ids.astype("<i4").tobytes(), counts.astype("<i4").tobytes())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["lang", "ids", "counts"])


def quotas(sizes: dict[str, int], most_rows: int) -> dict[str, int]:
    """Rows to draw of each language, one at least: equal shares, refilled with what smaller languages leave."""
    out, left = {}, most_rows
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(sizes) - i)))
        left -= out[lang]
    return out


def fit(spark: SparkSession, docs: DataFrame, most_rows: int = 2400) -> Model | None:
    """Learn from labelled rows outside the held-out fold: at most most_rows of them (the documented bound).

    So at most most_rows languages can be learned: of more, the most frequent (then the first by
    name) are. Each of those gives its quota, one row at least; drawn rows are chosen by a hash.
    """
    ship(spark)
    usable = own(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()}
    if not sizes:
        return None
    quota = quotas(sizes, most_rows)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Chances leave a margin over the quota, such that less than a quota comes through once in a billion draws; the rank then makes it exact.
    asked = spark.createDataFrame([(x, quota[x], min(1.0, (2 * quota[x] + 30) / n)) for x, n in sorted(sizes.items())], "l_lang string, quota long, chance double")
    drawn = usable.join(F.broadcast(asked), F.col("lang") == F.col("l_lang")).where(u < F.col("chance"))  # at most most_rows languages
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", F.xxhash64("text")))
    drawn = drawn.withColumn("_rank", rank).where(F.col("_rank") <= F.col("quota"))
    drawn = drawn.select("lang", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a language's rows came out of one task
    rows = drawn.mapInArrow(_featured, "lang string, ids binary, counts binary").collect()  # at most most_rows, packed
    rows.sort(key=lambda r: (r["ids"], r["counts"], r["lang"]))  # whatever order tasks came in
    order = np.random.default_rng(11).permutation(len(rows)).tolist()
    unpack = lambda b: np.frombuffer(b, "<i4").astype(np.int64)
    return train([(unpack(rows[i]["ids"]), unpack(rows[i]["counts"]), rows[i]["lang"]) for i in order])


def _predicted(batches, model):
    m: Model | None = model.value
    for batch in K.bounded(batches):
        langs, scores, rejected = [], [], []
        for raw in K.texts(batch.column("text")):
            found = m.probabilities(raw.decode()) if m is not None and raw else None
            langs.append(UNKNOWN if found is None else m.langs[int(found[0].argmax())])
            scores.append(0.0 if found is None else m.score(*found))
            rejected.append(found is None or m.rejects(*found))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            [*batch.schema.names, "_lang_pred", "_score", "_rejected"],
        )


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with _lang_pred, _score and _rejected; nothing but the text is looked at."""
    ship(spark)
    schema = docs.schema
    for name, kind in (("_lang_pred", "string"), ("_score", "double"), ("_rejected", "boolean")):
        schema = type(schema)(list(schema.fields)).add(name, kind)
    return docs.mapInArrow(partial(_predicted, model=spark.sparkContext.broadcast(model)), schema)


def predict(spark: SparkSession, docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score, rejected."""
    model = model or fit(spark, docs, **options)
    return identify(spark, own(docs, "doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected")
    )
