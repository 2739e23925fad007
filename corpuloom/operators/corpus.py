"""Documents to term counts, vocabularies and feature statistics.

Long form throughout: (doc_id, term, tf). Counting is an explode and one aggregation that combines
before its shuffle; statistics per term aggregate those rows again.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators.ranking import global_rank
from corpuloom.session import dealt, ship


def tokens(docs: DataFrame, text: str = "text", nfkc: bool = False) -> DataFrame:
    """docs with tokens: the normalized ones, empty where punctuation stood."""
    source = X.nfkc(F.col(text)) if nfkc else F.col(text)
    return docs.withColumn("tokens", X.normalized(source))


def stemmed(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with their tokens stemmed: each distinct token once, joined back by value."""
    from corpuloom.functions.stemming import porter2

    placed = docs.select(*keys, F.posexplode_outer("tokens").alias("_pos", "_token"))
    stems = placed.select("_token").distinct().select(F.col("_token").alias("_t"), porter2("_token").alias("_stem"))
    return (
        placed.join(stems, F.col("_token").eqNullSafe(F.col("_t")))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_stem"))).alias("_p"))
        .select(*keys, F.array_compact(F.col("_p._stem")).alias("tokens"))
    )


def term_counts(docs: DataFrame, n: int = 1, stopwords: tuple[str, ...] = (), mode: str = "any", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, term, tf of docs with tokens."""
    grams = X.ngrams(F.col("tokens"), n, stopwords, mode)
    return docs.select(*keys, F.explode(grams).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def text_counts(docs: DataFrame, n: int = 1, stopwords: tuple[str, ...] = (), mode: str = "any", sentences: bool = False, lengths: bool = False, key: str = "doc_id") -> DataFrame:
    """key, term, tf of docs (key, text), as term_counts() of their tokens; with ``sentences`` key, stn, term, tf (unigrams only).
    ``lengths`` adds len, the sum of tf over the key.

    Texts meet by key, and are counted where they lie: only they are shuffled, no row per token or term.
    """
    if mode not in ("any", "all"):
        raise ValueError("mode must be any or all")
    if sentences and n > 1:
        raise ValueError("n-grams of sentences aren't counted")
    ship(docs.sparkSession)
    placed = dealt(docs.select(F.col(key).cast("long").alias("key"), "text"), keys=("key",))
    rows = placed.mapInArrow(partial(X.counted, n=n, stopwords=stopwords, mode=mode, sentences=sentences), "key long, stn long, term string, tf long, len long")
    return rows.select(F.col("key").alias(key), *(["stn"] if sentences else []), "term", "tf", *(["len"] if lengths else []))


def admitted(counts: DataFrame, more_than: int = 5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of documents with more than so many distinct features; statistics come after this."""
    features = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return counts.withColumn("_n", features).where(F.col("_n") > more_than).drop("_n")


def sentences_admitted(sentences: DataFrame, words_over: int = 2, features_least: int = 5, sentences_least: int = 2) -> DataFrame:
    """Sentences (doc_id, stn, term, tf) with more than two features, of documents with enough features and two sentences."""
    per = Window.partitionBy("doc_id", "stn")
    # dealt by document, which serves every step below: one shuffle
    kept = sentences.repartition("doc_id").withColumn("_w", F.count(F.lit(1)).over(per)).where(F.col("_w") > words_over)
    docs = kept.groupBy("doc_id").agg(F.size(F.collect_set("stn")).alias("_s"), F.size(F.collect_set("term")).alias("_f"))
    good = docs.where((F.col("_s") >= sentences_least) & (F.col("_f") >= features_least)).select("doc_id")
    return kept.drop("_w").join(good, "doc_id", "left_semi")


def vocabulary(counts: DataFrame, min_df: int = 0, max_df: int = 0) -> DataFrame:
    """term, df, ttf of terms with min_df < df < max_df (none above if max_df <= 0)."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))
    kept = stats.where(F.col("df") > min_df)
    return kept.where(F.col("df") < max_df) if max_df > 0 else kept


def indexed(vocab: DataFrame) -> DataFrame:
    """A vocabulary with idx, from 0 in order of the terms."""
    return global_rank(vocab, ["term"], "idx")


def closed(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Term counts within a vocabulary (term, idx); others are dropped."""
    return counts.join(vocab.select("term", "idx"), "term")


def class_stats(counts: DataFrame, labels: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """term, df_c and ttf_c per class c."""
    y = F.col("y")
    aggs = []
    for c in classes:
        aggs += [F.count(F.when(y == c, 1)).alias(f"df_{c}"), F.coalesce(F.sum(F.when(y == c, F.col("tf"))), F.lit(0)).alias(f"ttf_{c}")]
    return counts.join(labels.select("doc_id", "y"), "doc_id").groupBy("term").agg(*aggs)


def background(vocab: DataFrame) -> DataFrame:
    """term, p: (1 + ttf) / (sum of ttf + vocabulary size)."""
    whole = vocab.agg(F.sum("ttf").alias("_s"), F.count(F.lit(1)).alias("_v"))
    return vocab.crossJoin(F.broadcast(whole)).select("term", ((F.col("ttf") + 1) / (F.col("_s") + F.col("_v"))).alias("p"))


def global_lm(counts: DataFrame, vocab: DataFrame, floor: float = 1e-4) -> DataFrame:
    """term, p over a vocabulary: its share of all counted words, the floor where it has none."""
    whole = counts.join(vocab.select("term"), "term", "left_semi").agg(F.sum("tf").alias("_s"))
    sums = counts.groupBy("term").agg(F.sum("tf").alias("_n"))
    p = F.coalesce(F.col("_n") / F.col("_s"), F.lit(floor))
    return vocab.select("term").join(sums, "term", "left").crossJoin(F.broadcast(whole)).select("term", p.alias("p"))


def lengths(counts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("tf").alias("len"))


def summed(counts: DataFrame, group: str, value: str = "tf") -> DataFrame:
    """Profiles: the sum of the vectors of a group's documents."""
    return counts.groupBy(group, "term").agg(F.sum(value).alias(value))


def l1(vectors: DataFrame, group: str, value: str = "tf") -> DataFrame:
    s = F.sum(F.abs(value)).over(Window.partitionBy(group))
    return vectors.withColumn(value, F.when(s > 0, F.col(value) / s).otherwise(F.col(value)))


def l2(vectors: DataFrame, group: str, value: str = "tf") -> DataFrame:
    s = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(group)))
    return vectors.withColumn(value, F.when(s > 0, F.col(value) / s).otherwise(F.col(value)))


def projected(vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Features renamed by (term, new_term); others are dropped."""
    return vectors.join(mapping, "term").drop("term").withColumnRenamed("new_term", "term")


def vectors(counts: DataFrame, value: str = "tf", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, features: array of (idx, val) in order of idx, from counts with idx."""
    pair = F.struct(F.col("idx").cast("int").alias("idx"), F.col(value).cast("double").alias("val"))
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("features"))


def top(rows: DataFrame, group: str, by: Column, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; ties go by a second key. Spark limits before its shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(by.desc(), tie))).where(F.col("rank") <= k)


def class_sizes(docs: DataFrame, label: str, size: str) -> DataFrame:
    """Per class its documents and their greatest size, and how many classes there are."""
    each = docs.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest"))
    return each.crossJoin(F.broadcast(each.agg(F.count(F.lit(1)).alias("n_classes"))))  # one row
