"""Queries of the text pipeline, weighting and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import corpus as C
from corpuloom.operators import weighting as W
from corpuloom.plans import common as P
from corpuloom.plans.common import r6
from corpuloom.plans.registry import query
from corpuloom.session import Scratch


@query(f"""WITH {P.STATS}, w AS (SELECT doc_id, term, tf::DOUBLE / len * ln((n + 1) / df::DOUBLE) AS w FROM st),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
rk AS (SELECT doc_id, term, round(w, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS rank FROM nw)
SELECT doc_id, term, weight, rank FROM rk WHERE rank <= 10""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its ten best terms by L2-normalized TF-IDF."""
    w = W.weighted(P.counts(spark, sf_dir, lengths=True), "tfidf", norm=2)
    return C.top(w.select("doc_id", "term", r6("w", "weight")), "doc_id", F.col("weight"), "term", 10)


@query(f"WITH {P.NORM} SELECT doc_id, pos, tok FROM norm")
def tokenize_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tokens(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("p", "tok")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "tok")


_BI = f"""{P.NORM}, prev AS (SELECT *, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS before, lag(tok, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS before2 FROM norm)"""


@query(f"""WITH {_BI}, g AS (
SELECT doc_id, tok AS term FROM norm WHERE {P.legit('tok')}
UNION ALL SELECT doc_id, before || '-' || tok FROM prev WHERE tok <> '' AND before <> '' AND ({P.legit('tok')} OR {P.legit('before')}))
SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term""")
def ngram_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uni- and bigrams, any part legitimate (the default)."""
    return P.counts(spark, sf_dir, 2)


@query(f"""WITH {_BI}, g AS (
SELECT doc_id, tok AS term FROM norm WHERE {P.legit('tok')}
UNION ALL SELECT doc_id, before || '-' || tok FROM prev WHERE tok <> '' AND before <> '' AND {P.legit('tok')} AND {P.legit('before')}
UNION ALL SELECT doc_id, before2 || '-' || before || '-' || tok FROM prev WHERE tok <> '' AND before <> '' AND before2 <> ''
  AND {P.legit('tok')} AND {P.legit('before')} AND {P.legit('before2')})
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term""")
def ngram_trigrams_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uni- to trigrams, all parts legitimate, counted over the corpus."""
    grams = C.text_counts(P.table(spark, sf_dir, "documents"), 3, P.STOPWORDS, mode="all")
    return grams.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"WITH {P.NORM} SELECT doc_id, round(1 - count(*) FILTER ({P.legit('tok')}) / count(*)::DOUBLE, 6) AS proportion FROM norm GROUP BY doc_id")
def stopword_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tokens(spark, sf_dir).where(F.size("tokens") > 0).select("doc_id", r6(X.stopword_proportion(F.col("tokens"), P.STOPWORDS), "proportion"))


@query(f"WITH {P.CNT} SELECT doc_id, count(*) AS n_features, sum(tf)::BIGINT AS len FROM cnt GROUP BY doc_id HAVING count(*) > 5")
def doc_admission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.admitted(P.counts(spark, sf_dir), 5)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("tf").alias("len"))


_SENT = rf"""{P.NORM}, seg AS (SELECT *, count(*) FILTER (tok = '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stn FROM norm),
sc AS (SELECT doc_id, stn, tok AS term, count(*) AS tf FROM seg WHERE {P.legit('tok')} GROUP BY doc_id, stn, tok),
ks AS (SELECT *, count(*) OVER (PARTITION BY doc_id, stn) AS w FROM sc QUALIFY w > 2),
ok AS (SELECT doc_id FROM ks GROUP BY doc_id HAVING count(DISTINCT stn) >= 2 AND count(DISTINCT term) >= 5)"""


@query(f"WITH {_SENT} SELECT doc_id, count(DISTINCT stn) AS n_sentences, sum(tf)::BIGINT AS n_words FROM ks WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY doc_id")
def sentence_admission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences end at punctuation; those of more than two features count."""
    counts = P.sentence_counts(spark, sf_dir)
    return C.sentences_admitted(counts).groupBy("doc_id").agg(F.countDistinct("stn").alias("n_sentences"), F.sum("tf").alias("n_words"))


@query(f"WITH {P.CNT} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf, row_number() OVER (ORDER BY term) - 1 AS idx FROM cnt GROUP BY term HAVING count(*) > 2 AND count(*) < 500")
def vocab_df_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indexed(C.vocabulary(P.counts(spark, sf_dir), 2, 500)).select("term", "df", "ttf", F.col("idx").cast("long").alias("idx"))


@query(f"""WITH {P.CNT}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM cnt GROUP BY term HAVING count(*) > 2)
SELECT doc_id, idx, tf FROM cnt JOIN v USING (term)""")
def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.counts(spark, sf_dir)
    return C.closed(counts, C.indexed(C.vocabulary(counts, 2))).select("doc_id", F.col("idx").cast("long").alias("idx"), "tf")


@query(f"""WITH {P.CNT}, v AS (SELECT term, row_number() OVER (ORDER BY term) AS idx FROM cnt GROUP BY term HAVING count(*) > 20)
SELECT doc_id, string_agg(idx || ':' || tf, ' ' ORDER BY idx) AS features FROM cnt JOIN v USING (term) GROUP BY doc_id""")
def libsvm_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the exchange format, without their label."""
    counts = P.counts(spark, sf_dir)
    rows = C.vectors(C.closed(counts, C.indexed(C.vocabulary(counts, 20))))
    text = F.array_join(F.transform("features", lambda p: F.concat_ws(":", (p["idx"] + 1).cast("string"), p["val"].cast("long").cast("string"))), " ")
    return rows.select("doc_id", text.alias("features"))


@query(f"WITH {P.CLASS} SELECT term, df_0, ttf_0, df_1, ttf_1 FROM cs")
def feature_stats_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_stats(P.counts(spark, sf_dir), P.labels(spark, sf_dir))


@query(f"WITH {P.CNT}, v AS (SELECT term, sum(tf) AS ttf FROM cnt GROUP BY term) SELECT term, round((1 + ttf)::DOUBLE / (SELECT sum(ttf) + count(*) FROM v), 9) AS p FROM v")
def background_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.background(C.vocabulary(P.counts(spark, sf_dir))).select("term", F.round("p", 9).alias("p"))


@query(f"""WITH {P.CNT}, v AS (SELECT term FROM cnt GROUP BY term HAVING count(*) > 2 UNION ALL SELECT 'zzz_unseen'),
s AS (SELECT term, sum(tf) AS n FROM cnt GROUP BY term), w AS (SELECT sum(tf) AS s FROM cnt WHERE term IN (SELECT term FROM v))
SELECT term, round(coalesce(n::DOUBLE / w.s, 1e-4), 9) AS p FROM v LEFT JOIN s USING (term) CROSS JOIN w""")
def global_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unigram model over a language-model vocabulary that also has a word the corpus lacks."""
    counts = P.counts(spark, sf_dir)
    vocab = C.vocabulary(counts, 2).select("term").unionByName(spark.sql("SELECT 'zzz_unseen' AS term"))
    return C.global_lm(counts, vocab).select("term", F.round("p", 9).alias("p"))


@query(f"WITH {P.CNT}, l AS (SELECT sum(tf) AS len FROM cnt GROUP BY doc_id) SELECT count(*) AS n_docs, round(avg(len), 6) AS avg_len, max(len)::BIGINT AS max_len FROM l")
def avg_doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lengths(P.counts(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_docs"), r6(F.avg("len"), "avg_len"), F.max("len").alias("max_len"))


_W = {
    "tfidf": "tf::DOUBLE / len * ln((n + 1) / df::DOUBLE)",
    "sublinear": "(1 + log10(tf)) * (1 + log10(n / df::DOUBLE))",
    "bm25": "ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (1.5 * (0.25 + 0.75 * len / avg_len) + tf)",
    "pln": "(1 + ln(1 + ln(tf)) / (0.5 + 0.5 * len / avg_len)) * ln((n + 1) / df::DOUBLE)",
    "tf": "tf::DOUBLE",
}


def _weights(spark: SparkSession, sf_dir: str, scheme: str, norm: int = 0) -> DataFrame:
    return W.weighted(P.counts(spark, sf_dir, lengths=True), scheme, norm).select("doc_id", "term", r6("w", "w"))


@query(f"WITH {P.STATS} SELECT doc_id, term, round({_W['tfidf']}, 6) AS w FROM st")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "tfidf")


@query(f"WITH {P.STATS} SELECT doc_id, term, round({_W['sublinear']}, 6) AS w FROM st")
def tfidf_sublinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "sublinear")


@query(f"WITH {P.STATS} SELECT doc_id, term, round({_W['bm25']}, 6) AS w FROM st")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "bm25")


@query(f"WITH {P.STATS} SELECT doc_id, term, round({_W['pln']}, 6) AS w FROM st")
def pln(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "pln")


@query(f"WITH {P.STATS} SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id)::DOUBLE, 6) AS w FROM st")
def l1_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "tf", 1)


@query(f"WITH {P.STATS}, b AS (SELECT doc_id, term, {_W['bm25']} AS w FROM st) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM b")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "bm25", 2)


@query(f"WITH {P.STATS} SELECT doc_id, round(avg(ln((n + 1) / df::DOUBLE)), 6) AS avg_idf FROM st GROUP BY doc_id")
def avg_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.average_idf(P.counts(spark, sf_dir, lengths=True)).select("doc_id", r6("avg_idf", "avg_idf"))


# Selection


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_stats(P.counts(spark, sf_dir), P.labels(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, selector: str, min_df: int = 0, max_df: int = 0, stats: DataFrame | None = None) -> DataFrame:
    labels = P.labels(spark, sf_dir)
    stats = _stats(spark, sf_dir) if stats is None else stats
    known = labels.join(P.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    sizes = known.agg(*[F.count(F.when(F.col("y") == c, 1)).alias(f"n_{c}") for c in (0, 1)])
    return W.scored(stats, sizes, selector, min_df, max_df)


def _plogp(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END)"


_F = f"""{P.CLASS}, f AS (SELECT term, df_0::DOUBLE AS a0, df_1::DOUBLE AS a1, (df_0 + df_1)::DOUBLE AS df, n0, n1, n0 + n1 AS n FROM cs CROSS JOIN sz)"""
_IG = f"""{_F}, ig AS (SELECT term, df, a0, a1, n0 / n AS p0, n1 / n AS p1, df / n AS pt,
  CASE WHEN df > 0 THEN a0 / n0 * (n0 / n) / (df / n) ELSE 0 END AS t0, CASE WHEN df > 0 THEN a1 / n1 * (n1 / n) / (df / n) ELSE 0 END AS t1,
  CASE WHEN df < n THEN (n0 - a0) / n0 * (n0 / n) / (1 - df / n) ELSE 0 END AS u0, CASE WHEN df < n THEN (n1 - a1) / n1 * (n1 / n) / (1 - df / n) ELSE 0 END AS u1 FROM f),
sc AS (SELECT term, df, -{_plogp('p0')} - {_plogp('p1')} + pt * ({_plogp('t0')} + {_plogp('t1')}) + (1 - pt) * ({_plogp('u0')} + {_plogp('u1')}) AS score FROM ig)"""
_CHI = f"""{_F}, x AS (SELECT *, n - df - n0 + a0 AS d0, n - df - n1 + a1 AS d1 FROM f),
sc AS (SELECT term, df,
  coalesce(n0 / n * CASE WHEN n0 * (df - a0 + d0) * df * (n0 - a0 + d0) <> 0 THEN n * (a0 * d0 - (df - a0) * (n0 - a0)) * (a0 * d0 - (df - a0) * (n0 - a0)) / n0 / (df - a0 + d0) / df / (n0 - a0 + d0) END, 0)
+ coalesce(n1 / n * CASE WHEN n1 * (df - a1 + d1) * df * (n1 - a1 + d1) <> 0 THEN n * (a1 * d1 - (df - a1) * (n1 - a1)) * (a1 * d1 - (df - a1) * (n1 - a1)) / n1 / (df - a1 + d1) / df / (n1 - a1 + d1) END, 0) AS score FROM x)"""


@query(f"WITH {P.CLASS} SELECT term, (df_0 + df_1)::DOUBLE AS score FROM cs WHERE df_0 + df_1 > 2 AND df_0 + df_1 < 300")
def fs_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "DF", 2, 300)


@query(f"WITH {_IG} SELECT term, round(score, 6) AS score FROM sc")
def fs_ig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "IG").select("term", r6("score", "score"))


@query(f"""WITH {_F} SELECT term, round(n0 / n * ln(a0 * n / n0 * df) + n1 / n * ln(a1 * n / n1 * df), 6) AS score FROM f WHERE a0 > 0 AND a1 > 0""")
def fs_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that one class lacks score minus infinity and are left out here."""
    return _scored(spark, sf_dir, "MI").where(F.col("score") > float("-inf")).select("term", r6("score", "score"))


@query(f"WITH {_CHI} SELECT term, round(score, 6) AS score FROM sc")
def fs_chi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "CHI").select("term", r6("score", "score"))


@query(f"""WITH {_IG}, o AS (SELECT term, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6), term) - 1 AS place, count(*) OVER () AS n FROM sc WHERE df > 2)
SELECT term, score, place FROM o WHERE place >= floor(n * 0.9) AND place < floor(n * 1.0)""")
def fs_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir, "IG", 2).select("term", r6("score", "score"))
    return W.sliced(scores, 0.9, 1.0).select("term", "score", F.col("place").cast("long").alias("place"))


@query(f"WITH {_CHI} SELECT term, round(score, 6) AS score FROM sc WHERE df > 2 ORDER BY 2 DESC, 1 LIMIT 100")
def fs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best(_scored(spark, sf_dir, "CHI", 2).select("term", r6("score", "score")), 100)


@query(f"""WITH {_CHI.replace('sc AS', 'chi AS')}, {_IG.split(_F + ', ')[1].replace('sc AS', 'igs AS')},
a AS (SELECT term, percent_rank() OVER (ORDER BY round(score, 6) DESC, term) AS place FROM chi WHERE df > 2),
b AS (SELECT term, percent_rank() OVER (ORDER BY round(score, 6) DESC, term) AS place FROM igs WHERE df > 2)
SELECT term, round(min(place), 6) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY term ORDER BY min(place), term LIMIT 100""")
def fs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark, "union").table(_stats(spark, sf_dir), "stats")  # of both selections
    a, b = (_scored(spark, sf_dir, s, 2, stats=stats).select("term", r6("score", "score")) for s in ("CHI", "IG"))
    return W.union_best(a, b, 100).select("term", r6("place", "place"))


# Scalar functions


@query(r"""SELECT page_id, trim(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS cleaned, NOT regexp_matches(html, '[A-Za-z0-9]$') AS ends_with_punct FROM pages""")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("cleaned"), X.ends_with_punctuation(F.col("html")).alias("ends_with_punct"))


@query("""SELECT doc_id, len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'nn')) AS n_nn,
length(text) - length(replace(text, 'e', '')) AS n_e FROM documents""")
def count_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return P.table(spark, sf_dir, "documents").select(
        "doc_id", X.count_overlapping(text, "nn").cast("long").alias("n_nn"), X.count_overlapping(text, "e").cast("long").alias("n_e")
    )


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'NULL') AS k, coalesce(json_extract_string(props, '$.missing'), 'NULL') AS missing FROM events""")
def json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return P.table(spark, sf_dir, "events").select("event_id", X.json_string(props, "k").alias("k"), X.json_string(props, "missing").alias("missing"))


@query("""SELECT event_id, to_json({'id': event_id, 'type': event_type}) AS built, json_array_length('[' || (event_id % 7) || ',2]') AS n FROM events""")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events")
    built = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    array = F.concat(F.lit("["), (F.col("event_id") % 7).cast("string"), F.lit(",2]"))
    return events.select("event_id", built.alias("built"), F.json_array_length(array).cast("long").alias("n"))


@query(f"""WITH {P.NORM}, t AS (SELECT DISTINCT tok FROM norm) SELECT count(*) AS n_tokens, count(*) FILTER (tok = 'NUM') AS n_num, max(length(tok)) AS longest FROM t""")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tokens(spark, sf_dir).select(F.explode("tokens").alias("tok")).distinct()
    return t.agg(F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(F.col("tok") == "NUM", 1)).alias("n_num"), F.max(F.length("tok")).cast("long").alias("longest"))


@query()
def porter2_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of stems; SQL has no stemmer (tested against published pairs)."""
    from corpuloom.session import ship

    ship(spark)
    counts = C.term_counts(C.stemmed(P.tokens(spark, sf_dir)), 1, P.STOPWORDS)
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
