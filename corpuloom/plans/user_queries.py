"""Queries of the user, item and network layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import corpus as C
from corpuloom.operators import network as N
from corpuloom.operators import users as U
from corpuloom.plans import common as P
from corpuloom.plans.common import r6
from corpuloom.plans.registry import query


@query(f"WITH {P.POSTS} SELECT user_id, item_id, order_id, line, seller_id, (rating >= 4)::INT AS y FROM posts WHERE rating <> 3")
def drop_neutral_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.binarized(P.posts(spark, sf_dir)).select("user_id", "item_id", "order_id", "line", "seller_id", "y")


@query("SELECT doc_id, (n_chars >= 1000)::INT AS y FROM documents")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below a threshold to 0, others to 1."""
    return P.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 1000, 0).otherwise(1).alias("y"))


@query(f"""WITH {P.POSTS}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM posts WHERE rating <> 3)
SELECT user_id, count(*) AS n_posts FROM k WHERE n >= 2 GROUP BY user_id""")
def min_two_docs_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.at_least(U.binarized(P.posts(spark, sf_dir)), 2).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))


_SPLIT = f"""{P.POSTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {P.SQL_ORDER}) - 1 AS ord, count(*) OVER (PARTITION BY user_id) AS n FROM posts),
sp AS (SELECT *, CASE WHEN ord < floor(n * 0.25) THEN 'TRAIN' WHEN ord < greatest(floor(n * 0.75), floor(n * 0.25) + 1) THEN 'ADAPTATION' ELSE 'TEST' END AS split FROM o)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.time_split(P.posts(spark, sf_dir), P.ORDER, enforce=True)


@query(f"WITH {_SPLIT} SELECT user_id, item_id, order_id, line, ord, split FROM sp")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("user_id", "item_id", "order_id", "line", F.col("ord").cast("long").alias("ord"), "split")


@query(f"""WITH {P.POSTS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY {P.SQL_ORDER}) AS k FROM posts)
SELECT user_id, item_id, order_id, line, rating FROM f WHERE k = 1""")
def dedupe_user_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.first_per_item(P.posts(spark, sf_dir), P.ORDER).select("user_id", "item_id", "order_id", "line", "rating")


@query(f"""WITH {_SPLIT} SELECT user_id, item_id, CASE WHEN split = 'ADAPTATION' THEN 'train' ELSE 'test' END AS part, arg_max(rating, ord) AS rating FROM sp GROUP BY 1, 2, 3""")
def train_test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.train_test_items(_split(spark, sf_dir))


@query(f"""WITH {P.POSTS}, c AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_posts, row_number() OVER (PARTITION BY item_id ORDER BY {P.SQL_ORDER}, user_id) AS k FROM posts WHERE rating = 2),
s AS (SELECT * FROM c WHERE n_posts > 5 AND n_posts <= 10 AND k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {P.SQL_ORDER}) AS one FROM s)
SELECT user_id, item_id, n_posts FROM o WHERE one = 1""")
def recommendation_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = P.posts(spark, sf_dir).where(F.col("rating") == 2)
    return U.recommendation_seeds(posts, P.ORDER).select("user_id", "item_id", "n_posts")


@query(f"WITH {P.POSTS} SELECT item_id, round(avg((rating >= 4)::INT), 6) AS pos_ratio, count(*) AS n FROM posts WHERE rating <> 3 GROUP BY item_id")
def pos_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.binarized(P.posts(spark, sf_dir)).groupBy("item_id").agg(r6(F.avg("y"), "pos_ratio"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P.POSTS}, b AS (SELECT user_id, count(*) AS n, sum((rating >= 4)::INT) AS pos FROM posts WHERE rating <> 3 GROUP BY user_id)
SELECT median(n) AS median_posts, max(n) AS max_posts, sum(n)::BIGINT AS total, sum(pos)::BIGINT AS positives, round(sum(pos)::DOUBLE / sum(n), 6) AS ratio FROM b""")
def median_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = U.binarized(P.posts(spark, sf_dir)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return per.agg(F.median("n").alias("median_posts"), F.max("n").alias("max_posts"), F.sum("n").alias("total"), F.sum("pos").alias("positives"), r6(F.sum("pos") / F.sum("n"), "ratio"))


@query(f"""WITH {P.POSTS}, b AS (SELECT user_id, count(*) AS n FROM posts GROUP BY user_id)
SELECT CASE WHEN n > 45 THEN 'heavy' WHEN n > 35 THEN 'medium' ELSE 'light' END AS stratum, count(*) AS n_users, max(n) AS most FROM b GROUP BY 1""")
def bucket_light_medium_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = P.posts(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(U.stratum(F.col("n"), 35, 45).alias("stratum")).agg(F.count(F.lit(1)).alias("n_users"), F.max("n").alias("most"))


_DOCUSER = f"{P.CNT}, prof AS (SELECT source, term, sum(tf)::BIGINT AS tf FROM cnt JOIN documents USING (doc_id) GROUP BY source, term)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as users: the sum of their documents' vectors."""
    owners = P.table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.summed(P.counts(spark, sf_dir).join(owners, "doc_id"), "source")


@query(f"WITH {_DOCUSER} SELECT source, term, round(tf / sum(tf) OVER (PARTITION BY source)::DOUBLE, 9) AS p FROM prof")
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.l1(_profiles(spark, sf_dir), "source").select("source", "term", F.round("tf", 9).alias("p"))


@query("""SELECT l_partkey AS item_id, s.s_nationkey AS feature, count(*) AS tf, round(count(*) / sum(count(*)) OVER (PARTITION BY l_partkey)::DOUBLE, 6) AS share
FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the nations that supply them."""
    lines, sellers = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "supplier")
    rows = lines.join(sellers, lines["l_suppkey"] == sellers["s_suppkey"]).select(F.col("l_partkey").alias("item_id"), F.col("s_nationkey").alias("term"), F.lit(1).alias("tf"))
    profile = C.summed(rows, "item_id")
    return C.l1(profile.withColumn("share", F.col("tf")), "item_id", "share").select("item_id", F.col("term").alias("feature"), "tf", r6("share", "share"))


@query(f"""WITH {_DOCUSER}, nm AS (SELECT source, sqrt(sum(tf::DOUBLE * tf)) AS norm FROM prof GROUP BY source)
SELECT a.source AS a, b.source AS b, round(coalesce((SELECT sum(p.tf::DOUBLE * q.tf) FROM prof p JOIN prof q USING (term) WHERE p.source = a.source AND q.source = b.source), 0) / (a.norm * b.norm), 6) AS cosine
FROM nm a JOIN nm b ON a.source < b.source""")
def profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all pairs of sources (a fixed handful) by their profiles."""
    profiles = _profiles(spark, sf_dir)
    names = profiles.select("source").distinct()
    pairs = names.select(F.col("source").alias("a")).join(names.select(F.col("source").alias("b")), F.col("a") < F.col("b"))
    return U.profile_similarity(profiles, pairs, "source").select("a", "b", r6("cosine", "cosine"))


@query("""WITH o AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
r AS (SELECT *, sum((prev IS NULL OR prev <> event_type)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM r GROUP BY user_id, run""")
def group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's consecutive events of one type, and their mean value."""
    rows = U.runs(P.table(spark, sf_dir, "events"), ["ts", "event_id"], "event_type", "user_id")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "avg_value"))


# Network


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.symmetric(P.follows(spark, sf_dir), P.users(spark, sf_dir))


@query(f"WITH {P.FOLLOWS} SELECT src, dst FROM edges")
def symmetrize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {P.FOLLOWS} SELECT DISTINCT a.src, a.dst FROM follows a JOIN follows b ON a.src = b.dst AND a.dst = b.src")
def mutual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.mutual(P.follows(spark, sf_dir))


@query(f"WITH {P.FOLLOWS} SELECT src, count(*) AS degree, array_to_string(list_sort(list(dst)), ',') AS friends FROM edges GROUP BY src")
def friend_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends = F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda d: d.cast("string")), ",")
    return _edges(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), friends.alias("friends"))


@query(f"""WITH {_SPLIT}, b AS (SELECT DISTINCT user_id, item_id FROM sp WHERE split = 'ADAPTATION')
SELECT x.user_id AS a, y.user_id AS b, count(*) AS n_shared FROM b x JOIN b y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1, 2""")
def copurchase_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users with an item in common among their adaptation posts."""
    return N.shared_items(_split(spark, sf_dir).where(F.col("split") == "ADAPTATION"))


@query(f"""WITH {P.THREADS}, q AS (SELECT q.post_id, count(a.post_id) AS n FROM threads q LEFT JOIN threads a ON a.parent_id = q.post_id WHERE q.parent_id = -1 GROUP BY 1)
SELECT count(*) AS n_questions, count(*) FILTER (n > 0) AS n_answered, count(*) FILTER (n > 1) AS n_many, round(avg(n) FILTER (n > 0), 6) AS avg_answers FROM q""")
def qa_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.answer_stats(P.threads(spark, sf_dir), 1).withColumn("avg_answers", F.round("avg_answers", 6))


_QA_EDGES = """qedges AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM threads a JOIN threads b ON a.post_id = b.parent_id WHERE a.user_id <> b.user_id AND b.user_id % 3 <> 0)"""


def _qa_edges(threads: DataFrame) -> DataFrame:
    a, b = threads.select(F.col("post_id").alias("p"), F.col("user_id").alias("src")), threads.select(F.col("parent_id").alias("p"), F.col("user_id").alias("dst"))
    return a.join(b, "p").where((F.col("src") != F.col("dst")) & (F.col("dst") % 3 != 0)).select("src", "dst").distinct()


@query(f"""WITH {P.THREADS}, {_QA_EDGES}, q AS (SELECT * FROM threads WHERE parent_id = -1),
j AS (SELECT q.post_id AS question, q.user_id AS asker, a.post_id AS answer, a.user_id AS answerer, a.user_id IN (SELECT user_id FROM q) AS asks
      FROM q JOIN threads a ON a.parent_id = q.post_id),
g AS (SELECT question FROM j GROUP BY question HAVING count(*) BETWEEN 1 AND 5 AND bool_and(asks))
SELECT question, asker, answer, answerer FROM j WHERE question IN (SELECT question FROM g)
AND EXISTS (SELECT 1 FROM qedges e WHERE e.src = asker AND e.dst = answerer)""")
def qa_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = P.threads(spark, sf_dir)
    return N.selected_questions(threads, _qa_edges(threads), least=1)


@query(f"WITH {P.FOLLOWS}, gone AS (SELECT src, dst FROM edges WHERE (src + dst) % 10 = 0 AND src < dst) SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE (g.src = e.src AND g.dst = e.dst) OR (g.src = e.dst AND g.dst = e.src))")
def remove_test_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return N.without(edges, edges.where(((F.col("src") + F.col("dst")) % 10 == 0) & (F.col("src") < F.col("dst"))))


@query(f"""WITH {P.FOLLOWS}, u AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),
d AS (SELECT src, least(2 * count(*), any_value(n) - 1 - count(*)) AS want, 2 * least(2 * count(*), any_value(n) - 1 - count(*)) > any_value(n) - 1 - count(*) AS dense
      FROM edges CROSS JOIN (SELECT count(*) AS n FROM customer) GROUP BY src),
t AS (SELECT src, want, unnest(range(1, want * 64 + 1)) AS try FROM d WHERE NOT dense),
h AS (SELECT src, want, try AS place, {P.sql_hash('src', 'try')} % (SELECT count(*) FROM customer) AS r FROM t
      UNION ALL SELECT src, want, {P.sql_hash('src', 'r')}, r FROM d CROSS JOIN u WHERE dense),
f AS (SELECT src, id AS dst, min(place) AS place, any_value(want) AS want FROM h JOIN u USING (r) WHERE src <> id GROUP BY src, id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY place, dst) AS rank FROM f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = f.src AND e.dst = f.dst))
SELECT src, dst FROM k WHERE rank <= want""")
def non_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of twice as many strangers as a user has friends (sampling is the feature)."""
    return N.non_neighbours(_edges(spark, sf_dir), P.users(spark, sf_dir), 2)


_PAIRS = f"""{P.FOLLOWS}, fe AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY {P.sql_hash('src', 'dst')}, dst) - 1) % 5 AS fold FROM edges WHERE src < dst)"""


@query(f"WITH {_PAIRS} SELECT src, dst, fold FROM fe UNION ALL SELECT dst, src, fold FROM fe")
def edge_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.edge_folds(_edges(spark, sf_dir), 5).select("src", "dst", F.col("fold").cast("long").alias("fold"))


@query(f"""WITH {_PAIRS}, a AS (SELECT src, dst, fold FROM fe UNION ALL SELECT dst, src, fold FROM fe)
SELECT src AS user_id, dst AS item_id, 1 AS rating, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part FROM a""")
def user_pairs_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test positives in both directions, as rating triples."""
    folds = N.edge_folds(_edges(spark, sf_dir), 5)
    return folds.select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"), F.lit(1).alias("rating"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))


@query(f"WITH {_PAIRS}, a AS (SELECT src, fold FROM fe UNION ALL SELECT dst, fold FROM fe) SELECT fold, count(*) AS n_edges, count(DISTINCT src) AS n_users FROM a GROUP BY fold")
def edge_fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = N.edge_folds(_edges(spark, sf_dir), 5)
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_users"))


# Folds and sampling

_FOLD = f"""{P.POSTS}, fo AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY {P.sql_hash('order_id', 'line', 'item_id')}, order_id, line, item_id, seller_id, rating) - 1) % 5 AS fold FROM posts)"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    keys = ["order_id", "line", "item_id"]
    w = Window.partitionBy("user_id").orderBy(U.hashed(*keys), *keys, "seller_id", "rating")
    return P.posts(spark, sf_dir).withColumn("fold", (F.row_number().over(w) - 1) % 5)


@query(f"WITH {_FOLD} SELECT user_id, fold, count(*) AS n FROM fo GROUP BY user_id, fold")
def fold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).groupBy("user_id", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FOLD}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {P.SQL_ORDER}) - 1 AS ord FROM fo)
SELECT user_id || ',' || ord || ',' || fold AS line FROM o""")
def fold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 'user,ordinal,fold'."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy(*P.ORDER)) - 1
    return _folds(spark, sf_dir).select(F.concat_ws(",", F.col("user_id").cast("string"), at.cast("string"), F.col("fold").cast("string")).alias("line"))


@query(f"WITH {_FOLD} SELECT fold, CASE WHEN fold = 0 THEN 'TEST' ELSE 'TRAIN' END AS split, count(*) AS n FROM fo GROUP BY 1, 2")
def fold_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.held_out(_folds(spark, sf_dir), 0).groupBy(F.col("fold").cast("long").alias("fold"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {P.sql_hash('doc_id', seed=3)} % 5 AS fold FROM documents")
def fold_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.random_folds(P.table(spark, sf_dir, "documents").select("doc_id"), 5, ["doc_id"], 3).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query(f"""WITH {P.POSTS}, b AS (SELECT user_id, count(*) AS n FROM posts GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN n > 45 THEN 'heavy' WHEN n > 35 THEN 'medium' ELSE 'light' END AS stratum FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {P.sql_hash('user_id')}, user_id) AS place FROM s)
SELECT user_id, stratum FROM k WHERE place <= 20""")
def cold_start_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty users of each stratum are reserved (sampling is the feature)."""
    per = P.posts(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", U.stratum(F.col("n"), 35, 45).alias("stratum"))
    return U.sampled(per, "stratum", 20, ["user_id"])


# Candidates, splits, summaries


@query(f"""WITH {P.FOLLOWS}, cand AS (SELECT DISTINCT src, dst FROM follows), k AS (SELECT src, dst FROM cand WHERE dst IN (SELECT c_custkey FROM customer)),
f AS (SELECT src, dst, (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k.dst AND o.o_orderkey % 7 = k.src % 7))::INT AS rel FROM k)
SELECT src AS user_id, dst AS item_id, rel FROM f WHERE src IN (SELECT src FROM f WHERE rel = 1)""")
def ranking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed customers as candidates; those with an order of the follower's residue are relevant."""
    from corpuloom.operators import selection as L

    follows = P.follows(spark, sf_dir).select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"))
    items = P.users(spark, sf_dir).select(F.col("user_id").alias("item_id"))
    orders = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 7).alias("r")).distinct()
    relevant = follows.join(orders, "item_id").where(F.col("user_id") % 7 == F.col("r")).select("user_id", "item_id")
    return L.ranking_candidates(follows, items, relevant).select("user_id", "item_id", "rel")


@query(f"""WITH {P.POSTS}, r AS (SELECT *, order_id * 8 + line AS id FROM posts),
o AS (SELECT *, row_number() OVER (PARTITION BY rating, seller_id ORDER BY {P.sql_hash('id')}, id) - 1 AS place, count(*) OVER (PARTITION BY rating, seller_id) AS n FROM r)
SELECT rating, seller_id, CASE WHEN place < floor(n * 0.8) THEN 'TRAIN' ELSE 'TEST' END AS split, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 to 20 within each rating and seller."""
    from corpuloom.operators import selection as L

    rows = P.posts(spark, sf_dir).withColumn("id", F.col("order_id") * 8 + F.col("line"))
    return L.stratified_split(rows, ["rating", "seller_id"], "id").groupBy("rating", "seller_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_partkey AS item_id, l_quantity::BIGINT % 3 AS topic, l_orderkey AS doc_id, l_linenumber AS stn, -l_extendedprice AS ll, l_quantity AS len FROM lineitem),
r AS (SELECT *, ll / len AS score, row_number() OVER (PARTITION BY item_id, topic ORDER BY ll / len DESC, doc_id, stn) AS rank FROM s)
SELECT item_id, topic, doc_id, stn, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's ranking on order lines: three per item and topic by score per unit."""
    from corpuloom.operators import selection as L

    lines = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"), (F.col("l_quantity").cast("long") % 3).alias("topic"), F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("stn"), (-F.col("l_extendedprice")).alias("ll"), F.col("l_quantity").alias("len"),
    )
    return L.best_sentences(lines).select("item_id", "topic", "doc_id", "stn", r6("score", "score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {P.STATS}, sw AS (SELECT doc_id, 1 - count(*) FILTER ({P.legit('tok')}) / count(*)::DOUBLE AS proportion FROM norm GROUP BY doc_id)
SELECT doc_id, any_value(len) AS len, count(*) AS n_terms, round(avg(tf), 6) AS mean_tf, round(any_value(proportion), 6) AS proportion, round(avg(ln((n + 1) / df::DOUBLE)), 6) AS avg_idf
FROM st JOIN sw USING (doc_id) GROUP BY doc_id""")
def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuloom.functions import text as X
    from corpuloom.operators import selection as L
    from corpuloom.operators import weighting as W

    counts = P.counts(spark, sf_dir)
    share = P.tokens(spark, sf_dir).select("doc_id", X.stopword_proportion(F.col("tokens"), P.STOPWORDS).alias("proportion"))
    return L.document_features(counts, share, W.average_idf(counts)).select("doc_id", "len", "n_terms", r6("mean_tf", "mean_tf"), r6("proportion", "proportion"), r6("avg_idf", "avg_idf"))


@query(f"""WITH {P.NORM}, seg AS (SELECT *, count(*) FILTER (tok = '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stn FROM norm)
SELECT doc_id, stn, count(DISTINCT tok) FILTER (tok IN ('the', 'of', 'and', 'tion')) AS n_keywords FROM seg WHERE tok <> '' GROUP BY doc_id, stn""")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from corpuloom.operators import selection as L

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = P.tokens(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    cut = placed.withColumn("stn", F.coalesce(F.count(F.when(F.col("term") == "", 1)).over(w), F.lit(0))).where(F.col("term") != "")
    words = spark.sql("SELECT explode(array('the', 'of', 'and', 'tion')) AS term")
    return L.keyword_counts(cut, words)
