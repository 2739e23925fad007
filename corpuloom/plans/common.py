"""What the registered queries share: tables, prepared inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import corpus as C
from corpuloom.session import Scratch, dealt, read_table

#: A short stop list for the registered queries; operators take any.
STOPWORDS = ("the", "and", "of", "to", "in", "is")


def r6(c: Column | str, name: str) -> Column:
    """Six decimals: both engines agree on them whatever the order of their sums."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6).alias(name)


def rounded(c: Column, places: int) -> Column:
    """round() of doubles from 0 to 1, up from halves, in arithmetic of doubles as the SQL's: Spark's own makes a decimal of each value."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "tokens")


def counts(spark: SparkSession, sf_dir: str, n: int = 1, lengths: bool = False) -> DataFrame:
    """Written once: the queries below use them several times, and tokenizing is most of their work. lengths adds len, the document's."""
    return Scratch(spark, "counts").table(C.text_counts(table(spark, sf_dir, "documents"), n, STOPWORDS, lengths=lengths), "counts")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stn, term, tf, written once; sentences end at punctuation."""
    return Scratch(spark, "sentences").table(C.text_counts(table(spark, sf_dir, "documents"), 1, STOPWORDS, sentences=True), "counts")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as posts of users on items, in order of time."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("long") % 5 + 1).alias("rating"),
        F.col("l_suppkey").alias("seller_id"),
    )


ORDER = ["ts", "order_id", "line", "item_id", "seller_id", "rating"]


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed network: customers to customers, with loops, repeats and unknown ends."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey") * 3) % 1600).alias("dst"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions and answers: a user's turn asks, later turns up to the next one answer."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    asked = F.when(F.col("role") == "user", F.col("turn"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    post = F.col("conv_id") * 1000 + F.col("turn")
    return (
        turns.withColumn("q", F.last(asked, ignorenulls=True).over(w)).where(F.col("q").isNotNull())
        .select(
            post.alias("post_id"),
            ((F.col("conv_id") * 13 + F.col("turn") * 7) % 41).alias("user_id"),
            F.when(F.col("role") == "user", F.lit(-1)).otherwise(F.col("conv_id") * 1000 + F.col("q")).cast("long").alias("parent_id"),
        )
    )


# The same in SQL.

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def legit(t: str) -> str:
    return f"(length({t}) > 1 AND length({t}) < 20 AND {t} NOT IN ({_STOP}))"


NORM = r"""
norm AS (
  SELECT doc_id, pos, CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'NUM' ELSE t END AS tok
  FROM (SELECT doc_id, generate_subscripts(ts, 1) AS pos, lower(regexp_replace(unnest(ts), '[^A-Za-z0-9_]+', '', 'g')) AS t
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D.,;:!?]+|[.,;:!?]+') AS ts FROM documents))
)"""
CNT = f"""{NORM},
cnt AS (SELECT doc_id, tok AS term, count(*) AS tf FROM norm WHERE {legit('tok')} GROUP BY doc_id, tok)"""
STATS = f"""{CNT},
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
lens AS (SELECT doc_id, sum(tf)::BIGINT AS len FROM cnt GROUP BY doc_id),
whole AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
st AS (SELECT c.doc_id, c.term, c.tf, d.df, l.len, w.n, w.avg_len FROM cnt c JOIN dfs d USING (term) JOIN lens l USING (doc_id) CROSS JOIN whole w)"""
CLASS = f"""{CNT},
lab AS (SELECT doc_id, quality AS y FROM labels),
cs AS (SELECT term, count(*) FILTER (y = 0) AS df_0, coalesce(sum(tf) FILTER (y = 0), 0)::BIGINT AS ttf_0,
              count(*) FILTER (y = 1) AS df_1, coalesce(sum(tf) FILTER (y = 1), 0)::BIGINT AS ttf_1
       FROM cnt JOIN lab USING (doc_id) GROUP BY term),
sz AS (SELECT count(*) FILTER (quality = 0)::DOUBLE AS n0, count(*) FILTER (quality = 1)::DOUBLE AS n1 FROM labels JOIN documents USING (doc_id))"""
POSTS = """
posts AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, o_orderkey AS order_id, l_linenumber AS line,
                 l_quantity::BIGINT % 5 + 1 AS rating, l_suppkey AS seller_id
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_ORDER = "ts, order_id, line, item_id, seller_id, rating"
FOLLOWS = """
follows AS (SELECT o_custkey AS src, (o_orderkey * 7 + o_custkey * 3) % 1600 AS dst FROM orders),
kept AS (SELECT DISTINCT src, dst FROM follows WHERE src <> dst AND src IN (SELECT c_custkey FROM customer) AND dst IN (SELECT c_custkey FROM customer)),
edges AS (SELECT src, dst FROM kept UNION SELECT dst, src FROM kept)"""
THREADS = """
turns AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS q
          FROM conversations WHERE role <> 'system'),
threads AS (SELECT conv_id * 1000 + turn AS post_id, (conv_id * 13 + turn * 7) % 41 AS user_id,
                   CASE WHEN role = 'user' THEN -1 ELSE conv_id * 1000 + q END AS parent_id
            FROM turns WHERE q IS NOT NULL)"""


def sql_hash(*columns: str, seed: int = 0) -> str:
    h = str(seed)
    for c in columns:
        h = f"((({h}::BIGINT * 31 + {c}::BIGINT * 40503 + 12345) % 2147483647) * 48271) % 2147483647"
        h = f"({h})"
    return h
