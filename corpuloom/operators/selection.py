"""Smaller pieces of the user layer: candidate lists, stratified splits, summaries, document features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.operators.users import hashed


def ranking_candidates(candidates: DataFrame, items: DataFrame, relevant: DataFrame) -> DataFrame:
    """candidates (user_id, item_id) that are known items, of users with a relevant one among them; with rel 0 or 1."""
    known = candidates.select("user_id", "item_id").distinct().join(items.select("item_id").distinct(), "item_id", "left_semi")
    flagged = known.join(relevant.select("user_id", "item_id").distinct().withColumn("rel", F.lit(1)), ["user_id", "item_id"], "left").na.fill(0, ["rel"])
    return flagged.withColumn("_any", F.max("rel").over(Window.partitionBy("user_id"))).where(F.col("_any") > 0).drop("_any")


def stratified_split(rows: DataFrame, strata: list[str], key: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """TRAIN for the first floor(n * train) rows of each stratum in a seeded order, TEST for others.

    A stratum's rows are ordered by a hash, so the split is one shuffle by stratum.
    """
    w = Window.partitionBy(*strata)
    at = F.row_number().over(w.orderBy(hashed(key, seed=seed), key)) - 1
    return rows.withColumn("split", F.when(at < F.floor(F.count(F.lit(1)).over(w) * train), "TRAIN").otherwise("TEST"))


def best_sentences(scores: DataFrame, k: int = 3) -> DataFrame:
    """scores (item_id, topic, doc_id, stn, ll, len): per item and topic the k sentences of the best score per word."""
    per_word = F.col("ll") / F.col("len")
    w = Window.partitionBy("item_id", "topic").orderBy(per_word.desc(), "doc_id", "stn")
    return scores.withColumn("score", per_word).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def document_features(counts: DataFrame, stopword_share: DataFrame, average_idf: DataFrame) -> DataFrame:
    """Per document its length, distinct terms, mean tf, stop-word proportion and mean IDF."""
    sizes = counts.groupBy("doc_id").agg(F.sum("tf").alias("len"), F.count(F.lit(1)).alias("n_terms"), F.avg("tf").alias("mean_tf"))
    return sizes.join(stopword_share, "doc_id").join(average_idf, "doc_id")


def keyword_counts(sentences: DataFrame, keywords: DataFrame) -> DataFrame:
    """sentences (doc_id, stn, term): how many distinct terms of each are keywords."""
    hit = F.col("_k").isNotNull()
    joined = sentences.select("doc_id", "stn", "term").distinct().join(keywords.select("term", F.lit(1).alias("_k")).distinct(), "term", "left")
    return joined.groupBy("doc_id", "stn").agg(F.count(F.when(hit, 1)).alias("n_keywords"))


def reserved_first(users: DataFrame, k: int, key: str = "user_id") -> DataFrame:
    """users with SEPARATE for the first k of them in order, null for others."""
    first = users.select(key).distinct().orderBy(key).limit(k).withColumn("split", F.lit("SEPARATE"))
    return users.join(first, key, "left")
