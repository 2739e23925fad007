"""Term weighting and feature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.operators.ranking import global_rank


def with_stats(counts: DataFrame) -> DataFrame:
    """counts with df, len (its document's), n (documents) and avg_len.

    df and len come from aggregations of the counts (len may be there already, which spares a join of theirs); the two
    scalars are one row. The frequencies come back to the counts by the terms' letters in reverse, by which neither side is
    partitioned yet: so both have an exchange of their own, and the rows of a term that most documents hold can be split in
    the join. The frequencies' part of the vocabulary is hashed, so that no counts are sorted.
    """
    known = "len" in counts.columns
    df = counts.groupBy(F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("df"))
    lens = counts.select("doc_id", "len").distinct() if known else counts.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    whole = lens.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    counted = counts.join(df.hint("shuffle_hash"), F.reverse("term") == F.reverse("_term")).drop("_term")
    return (counted if known else counted.join(lens, "doc_id")).crossJoin(F.broadcast(whole))


def idf() -> Column:
    return F.ln((F.col("n") + 1) / F.col("df"))


def tfidf() -> Column:
    return F.col("tf") / F.col("len") * idf()


def sublinear() -> Column:
    return (1 + F.log10("tf")) * (1 + F.log10(F.col("n") / F.col("df")))


def bm25(k1: float = 1.5, b: float = 0.75) -> Column:
    """May be negative for terms in over half of the documents."""
    tf, df, n = F.col("tf"), F.col("df"), F.col("n")
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    return F.ln((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (norm + tf)


def pivoted(s: float = 0.5) -> Column:
    """The 1 is added to the normalized part, not inside it."""
    norm = 1 - s + s * F.col("len") / F.col("avg_len")
    return (1 + F.ln(1 + F.ln("tf")) / norm) * idf()


SCHEMES = {"tf": lambda: F.col("tf").cast("double"), "tfidf": tfidf, "sublinear": sublinear, "bm25": bm25, "pln": pivoted}


def weighted(counts: DataFrame, scheme: str, norm: int = 0) -> DataFrame:
    """doc_id, term, w; norm 1 or 2 divides by that norm of the document's vector."""
    rows = with_stats(counts).select("doc_id", "term", SCHEMES[scheme]().alias("w"))
    if norm:
        per = Window.partitionBy("doc_id")
        s = F.sum(F.abs("w")).over(per) if norm == 1 else F.sqrt(F.sum(F.col("w") * F.col("w")).over(per))
        rows = rows.withColumn("w", F.when(s > 0, F.col("w") / s).otherwise(F.col("w")))
    return rows


def average_idf(counts: DataFrame) -> DataFrame:
    return with_stats(counts).groupBy("doc_id").agg(F.avg(idf()).alias("avg_idf"))


# Selection. stats: term, df_c per class; sizes: n_c documents per class.


def _columns(classes):
    df = {c: F.col(f"df_{c}").cast("double") for c in classes}
    n = {c: F.col(f"n_{c}").cast("double") for c in classes}
    return df, n, sum(df.values(), F.lit(0.0)), sum(n.values(), F.lit(0.0))


def _xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def document_frequency(classes=(0, 1)) -> Column:
    return _columns(classes)[2]


def information_gain(classes=(0, 1)) -> Column:
    df, n, df_all, n_all = _columns(classes)
    pt = df_all / n_all
    gain = F.lit(0.0)
    for c in classes:
        pc = n[c] / n_all
        with_t = F.when(pt > 0, df[c] / n[c] * pc / pt).otherwise(F.lit(0.0))
        without = F.when(pt < 1, (n[c] - df[c]) / n[c] * pc / (1 - pt)).otherwise(F.lit(0.0))
        gain = gain - _xlogx(pc) + pt * _xlogx(with_t) + (1 - pt) * _xlogx(without)
    return gain


def mutual_information(classes=(0, 1), textbook: bool = False) -> Column:
    """sum P(c) ln(df_c * N / n_c * df): the reference form multiplies by df, the textbook divides. A class
    without the term gives minus infinity."""
    df, n, df_all, n_all = _columns(classes)
    score = F.lit(0.0)
    for c in classes:
        inside = df[c] * n_all / n[c] / df_all if textbook else df[c] * n_all / n[c] * df_all
        score = score + n[c] / n_all * F.when(df[c] > 0, F.ln(inside)).otherwise(F.lit(float("-inf")))
    return score


def chi_square(n: Column, df: Column, term_class: Column, in_class: Column) -> Column:
    """N (AD - BC)^2 / (in_class * (B + D) * df * (C + D)), null where that is 0."""
    a, b, c = term_class, df - term_class, in_class - term_class
    d = n - df - in_class + term_class
    cross = a * d - b * c
    bottom = in_class * (b + d) * df * (c + d)
    return F.when(bottom != 0, n * cross * cross / in_class / (b + d) / df / (c + d))


def chi(classes=(0, 1)) -> Column:
    df, n, df_all, n_all = _columns(classes)
    return sum((n[c] / n_all * F.coalesce(chi_square(n_all, df_all, df[c], n[c]), F.lit(0.0)) for c in classes), F.lit(0.0))


SELECTORS = {"DF": document_frequency, "IG": information_gain, "MI": mutual_information, "CHI": chi}


def scored(stats: DataFrame, sizes: DataFrame, selector: str, min_df: int = 0, max_df: int = 0, classes=(0, 1)) -> DataFrame:
    """term, score of the terms with min_df < df < max_df."""
    rows = stats.crossJoin(F.broadcast(sizes))
    df_all = document_frequency(classes)
    rows = rows.where(df_all > min_df)
    if max_df > 0:
        rows = rows.where(df_all < max_df)
    return rows.select("term", SELECTORS[selector](classes).alias("score"))


def sliced(scores: DataFrame, start: float, end: float) -> DataFrame:
    """Of the terms in rising order of score, the places [floor(n start), floor(n end))."""
    ranked = global_rank(scores, ["score", "term"], "place")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).where((F.col("place") >= F.floor(F.col("_n") * start)) & (F.col("place") < F.floor(F.col("_n") * end))).drop("_n")


def best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "term").limit(k)


def union_best(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The k best of two selections, by each term's better place in either (from 0 at the top)."""
    def placed(s: DataFrame) -> DataFrame:
        ranked = global_rank(s, [F.desc("score"), F.asc("term")], "place")
        n = ranked.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_n"))
        return ranked.crossJoin(F.broadcast(n)).select("term", (F.col("place") / F.col("_n")).alias("place"))

    both = placed(a).unionByName(placed(b)).groupBy("term").agg(F.min("place").alias("place"))
    return both.orderBy("place", "term").limit(k)
