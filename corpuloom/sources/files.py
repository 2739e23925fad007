"""Readers of the text formats: vocabularies, user files, adjacency, folds, JSON reviews, lexicons, model dumps.

Everything is a DataFrame from Spark's own readers, so any path that Spark opens will do. Files of
several lines a record are read whole, one row each, and cut with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.functions.text import clamp_rating


def lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, value of one text file, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "value"))


#: Ending of a folder of packed files (``sinks.packed_files``): Parquet rows of a file's path and content.
PACKED = ".packed"


def directory(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """path, value: the files of a tree by suffix, whole; of packed files those rows."""
    if path.rstrip("/").endswith(PACKED):
        return spark.read.schema("path string, value string").parquet(path).where(F.col("path").endswith(suffix))
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def file_id(path: Column) -> Column:
    """A file's name up to its first dot."""
    name = F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))  # a plus in a path is a plus


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The columns, computed once per row: the optimizer would move expressions above a later explode, and a
    lambda would repeat them per element, which grows with the square of a file."""
    return rows.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(term, idx) in order of the lines, and the n-gram order of a '#NGram:n' comment (1 if there is none)."""
    rows = lines(spark, path).where(F.trim("value") != "")
    comment = F.col("value").startswith("#")
    n = rows.where(comment).select(F.regexp_extract("value", r"^#\s*NGram:\s*(\d+)", 1).alias("n")).where("n <> ''").agg(F.max(F.col("n").cast("int"))).first()[0]
    kept = rows.where(~comment)
    return kept.select(F.col("value").alias("term"), (F.row_number().over(Window.orderBy("pos")) - 1).alias("idx")), n or 1


def old_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """CSV of term, total, df_0, df_1: (term, idx, df_0, df_1), the number of documents in its TOTALDF row, the n-gram order."""
    cut = lines(spark, path).select("pos", F.split("value", ",").alias("c"))
    rows = cut.select("pos", F.get("c", F.lit(0)).alias("term"), *[F.get("c", F.lit(i)).try_cast("int").alias(n) for i, n in ((1, "total"), (2, "df_0"), (3, "df_1"))])
    total = rows.where(F.col("term") == "TOTALDF").agg(F.max("total")).first()[0]
    kept = rows.where((F.col("term") != "TOTALDF") & F.col("df_0").isNotNull())
    order = kept.agg(F.max(F.length("term") - F.length(F.replace("term", F.lit("-"), F.lit(""))))).first()[0]
    return kept.select("term", (F.row_number().over(Window.orderBy("pos")) - 1).alias("idx"), "df_0", "df_1"), total or 0, 1 + (order or 0)


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """One term per line: stop words, a language model's vocabulary."""
    return lines(spark, path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def plain_documents(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """A file is a document: its lines run together; y is 1 if 'pos' is in its path."""
    return directory(spark, path, suffix).select("path", F.regexp_replace("value", "[\r\n]+", "").alias("text"), F.col("path").contains("pos").cast("int").alias("y"))


def _records(files: DataFrame, names: list[str]) -> DataFrame:
    """Files of a header line and records of len(names) lines: owner, record number, one column per name."""
    n = len(names)
    body = F.split(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", ""), "\n")
    cut = once(files, user_id=file_id(F.col("path")), body=body)
    count = F.floor((F.size("body") - 1) / n).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    record = lambda k: F.struct(*[F.get("body", k * n + 1 + i).alias(name) for i, name in enumerate(names)])
    return cut.select("user_id", F.posexplode(F.transform(starts, record)).alias("rec", "r")).select("user_id", "rec", "r.*")


def user_reviews(spark: SparkSession, path: str, suffix: str = ".txt", least: int = 2) -> DataFrame:
    """user_id, ord, item_id, text, category, rating, ts, y: neutral ratings are dropped, users need ``least`` posts."""
    rows = _records(directory(spark, path, suffix), ["item_id", "text", "category", "rating", "ts"])
    rows = rows.withColumn("rating", F.col("rating").try_cast("int")).withColumn("ts", F.col("ts").try_cast("long"))
    kept = rows.where((F.col("rating") != 3) & F.col("ts").isNotNull())
    w = Window.partitionBy("user_id")
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    return kept.withColumn("ord", F.row_number().over(w.orderBy("rec")) - 1).withColumn("y", (F.col("rating") >= 4).cast("int")).drop("_n", "rec")


def user_threads(spark: SparkSession, path: str, suffix: str = ".txt", least: int = 2) -> DataFrame:
    """user_id, ord, post_id, text, parent_id (-1: a question), y, ts."""
    rows = _records(directory(spark, path, suffix), ["post_id", "text", "parent_id", "y", "ts"])
    for name, kind in (("post_id", "int"), ("parent_id", "int"), ("y", "int"), ("ts", "long")):
        rows = rows.withColumn(name, F.col(name).try_cast(kind))
    w = Window.partitionBy("user_id")
    kept = rows.where(F.col("post_id").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    return kept.withColumn("ord", F.row_number().over(w.orderBy("rec")) - 1).drop("_n", "rec")


def more_posts(known: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts of a second directory for users already known, as tests."""
    return posts.join(known.select("user_id").distinct(), "user_id", "left_semi").withColumn("split", F.lit("TEST"))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """'uid<TAB>f1<TAB>f2 ...' -> src, dst, as written."""
    cut = lines(spark, path).select(F.split("value", "\t").alias("p"))
    return cut.where(F.size("p") > 1).select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", 2, F.size("p") - 1)).alias("dst")).where("dst <> ''")


def document_folds(spark: SparkSession, path: str) -> DataFrame:
    """'uid,ordinal,fold' -> user_id, ord, fold."""
    c = F.split("value", ",")
    return lines(spark, path).where(F.size(c) >= 3).select(F.get(c, F.lit(0)).alias("user_id"), F.get(c, F.lit(1)).cast("int").alias("ord"), F.get(c, F.lit(2)).cast("int").alias("fold"))


def with_folds(posts: DataFrame, folds: DataFrame) -> DataFrame:
    """posts with their fold, -1 where none is given."""
    return posts.join(folds, ["user_id", "ord"], "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def strata(spark: SparkSession, prefix: str) -> DataFrame:
    """user_id, stratum from <prefix>_{light,medium,heavy}.txt, first column of tab-separated lines."""
    parts = [lines(spark, f"{prefix}_{s}.txt").select(F.split("value", "\t")[0].alias("user_id"), F.lit(s).alias("stratum")) for s in ("light", "medium", "heavy")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def user_weights(spark: SparkSession, path: str, suffix: str, size: int) -> DataFrame:
    """user_id, w from '<uid>.<suffix>' files of comma-separated numbers; others than size + 1 of them are dropped."""
    w = F.transform(F.split(F.trim("value"), r"\s*,\s*"), lambda x: x.try_cast("double"))
    return directory(spark, path, suffix).select(file_id(F.col("path")).alias("user_id"), w.alias("w")).where(F.size("w") == size + 1)


def user_vectors(spark: SparkSession, path: str, users: DataFrame, skip: int = 3, dim: int = 11) -> DataFrame:
    """user_id, vec from 'uid v1 v2 ...' after some header lines; users without one have zeros."""
    p = F.split(F.trim("value"), r"\s+")
    vec = F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x.cast("double"))
    rows = lines(spark, path).where((F.col("pos") >= skip) & (F.size(p) > 1)).select(p[0].alias("user_id"), vec.alias("vec"))
    return users.select("user_id").join(rows, "user_id", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))


def seed_words(spark: SparkSession, path: str, vocab: DataFrame, eta: float) -> DataFrame:
    """topic, name, idx, prior from 'name w1 w2 ...' lines; words outside the vocabulary are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.size(p) > 1).select(F.col("pos").alias("topic"), p[0].alias("name"), F.explode(F.slice(p, 2, F.size(p) - 1)).alias("term"))
    return rows.join(vocab, "term").select("topic", "name", "idx", F.lit(eta).alias("prior"))


def topic_terms(spark: SparkSession, path: str) -> DataFrame:
    """'K<TAB>V' and K rows of log-probabilities -> k, idx, logp."""
    cut = lines(spark, path).where(F.col("pos") > 0).select((F.col("pos") - 1).alias("k"), F.split(F.trim("value"), r"\s+").alias("p"))
    return cut.select("k", F.posexplode("p").alias("idx", "x")).select("k", "idx", F.col("x").try_cast("double").alias("logp")).where("logp IS NOT NULL")


def document_topics(spark: SparkSession, path: str) -> DataFrame:
    """Blocks behind '-----' lines: 'uid id N K' and N rows of K numbers -> user_id, ord, n, phi."""
    body = F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n")), "\n-----[^\n]*\n")
    block = spark.read.text(path, wholetext=True).select(F.explode(body).alias("b")).select(F.btrim("b", F.lit(" \n")).alias("b")).where("b <> ''")
    cut = block.select(F.split("b", "\n").alias("l")).select(F.split(F.get("l", F.lit(0)), r"\s+").alias("h"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))).alias("rows"))
    rows = cut.select(F.get("h", F.lit(0)).alias("user_id"), F.get("h", F.lit(1)).cast("int").alias("ord"), F.posexplode("rows").alias("n", "row"))
    return rows.select("user_id", "ord", "n", F.transform(F.split(F.trim("row"), r"\s+"), lambda x: x.cast("double")).alias("phi"))


def selected_questions(spark: SparkSession, path: str, posts: DataFrame) -> DataFrame:
    """posts named in 'uid qid' lines."""
    p = F.split(F.trim("value"), r"\s+")
    named = lines(spark, path).where(F.size(p) > 1).select(p[0].alias("user_id"), p[1].cast("int").alias("post_id")).distinct()
    return posts.join(named, ["user_id", "post_id"], "left_semi")


_REVIEW = "struct<Overall:string,Date:string,Content:string,Title:string,ReviewID:string,Author:string>"


def json_reviews(spark: SparkSession, path: str, array: str = "Reviews", product: str | None = None, suffix: str = ".json", date_format: str = "MMMM dd,yyyy") -> DataFrame:
    """One JSON object per file with an array of reviews -> item_id, review_id, user_id, title, text, rating, day, y.

    A review is valid with a rating of 1 to 5, a content and a date. y is 0 below 4, also for 3.
    ``product`` names a field for the item id (the file's name else). Malformed files give nothing.
    """
    files = directory(spark, path, suffix)
    item = F.get_json_object("value", f"$.{product}") if product else file_id(F.col("path"))
    parsed = once(files, item_id=item, reviews=F.from_json(F.get_json_object("value", f"$.{array}"), f"array<{_REVIEW}>"))
    rows = parsed.select("item_id", F.explode("reviews").alias("r"))
    day = F.coalesce(*[F.try_to_timestamp("r.Date", F.lit(f)) for f in (date_format, "MMM d, yyyy", "yyyy-MM-dd")])
    cut = rows.select(
        "item_id", F.col("r.ReviewID").alias("review_id"), F.col("r.Author").alias("user_id"), F.col("r.Title").alias("title"), F.col("r.Content").alias("text"),
        clamp_rating(F.col("r.Overall")).alias("rating"), day.alias("day"),
    )
    valid = cut.where(F.col("rating").between(1, 5) & F.col("text").isNotNull() & F.col("day").isNotNull())
    return valid.withColumn("y", F.when(F.col("rating") < 4, 0).otherwise(1))


def titled(rows: DataFrame) -> DataFrame:
    """Title and content as one text, a full stop between them where the title ends in none; y is the rating less 1."""
    joined = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.col("text")).when(F.col("title").rlike("[A-Za-z0-9]$"), F.concat("title", F.lit(". "), "text")).otherwise(F.concat("title", F.lit(" "), "text"))
    return rows.withColumn("text", joined).withColumn("y", F.col("rating") - 1)


def segmented_reviews(spark: SparkSession, path: str, product: str) -> DataFrame:
    """JSON lines of Rating, PublishDate, Pros, Cons, Comments, LoginNickName -> review_id and the three segments."""
    rows = spark.read.schema("Rating string, PublishDate string, Pros string, Cons string, Comments string, LoginNickName string").json(path)
    return rows.select(
        F.concat_ws("-", F.lit(product), "LoginNickName").alias("review_id"), F.col("LoginNickName").alias("user_id"), clamp_rating(F.col("Rating")).alias("rating"),
        F.col("PublishDate").alias("date"), F.array(*[F.coalesce(c, F.lit("NULL")) for c in ("Pros", "Cons", "Comments")]).alias("segments"),
    )


def products(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("ProductID string, Name string, Price string, Features string").json(path)
    return rows.select(*[F.coalesce(c, F.lit("NULL")).alias(n) for c, n in (("ProductID", "item_id"), ("Name", "name"), ("Price", "price"), ("Features", "features"))])


def sentiment_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """'POS ID PosS NegS term#rank ... gloss' -> term, pos, score.

    A term's synsets are folded in order of rank: scores other than 0 are added and counted, and
    after each synset the score so far is divided by the count so far. So later synsets weigh more
    than in a mean; this is the published lexicon reader's result, kept as it is. Terms are stemmed
    like tokens by the caller.
    """
    c = F.split("value", "\t")
    cut = lines(spark, path).where(~F.trim("value").startswith("#") & (F.size(c) == 6)).select("pos", c[0].alias("tag"), (c[2].cast("double") - c[3].cast("double")).alias("s"), F.explode(F.split(c[4], " ")).alias("t"))
    named = cut.select("pos", "tag", "s", F.substring_index("t", "#", 1).alias("term"), F.substring_index("t", "#", -1).cast("int").alias("rank"))
    last = named.groupBy("term", "tag", "rank").agg(F.max_by("s", "pos").alias("s"))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"])
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("n"))

    def fold(acc: Column, s: Column) -> Column:
        v, n = acc["v"] + s, acc["n"] + F.when(s != 0, 1.0).otherwise(0.0)
        return F.struct(F.when(v != 0, v / n).otherwise(v).alias("v"), n.alias("n"))

    return last.groupBy("term", F.col("tag").alias("pos")).agg(F.aggregate(scores, start, fold)["v"].alias("score"))


def sentiment_score(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens (doc_id, term, tag): Penn tags become n, a, v, r; the found scores' sum over the number of tokens."""
    tag = F.substring("tag", 1, 2)
    pos = F.when(tag == "NN", "n").when(tag == "JJ", "a").when(tag == "VB", "v").when(tag == "RB", "r")
    found = tokens.withColumn("pos", pos).join(lexicon, ["term", "pos"], "left")
    return found.groupBy("doc_id").agg((F.coalesce(F.sum("score"), F.lit(0.0)) / F.count(F.lit(1))).alias("score"))


def tagged_counts(tokens: DataFrame, prefixes: tuple[str, ...] = ("RB", "JJ")) -> DataFrame:
    """Term counts of tagged tokens (doc_id, term, tag) of some tags: adverbs and adjectives."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("tag").startswith(p)
    return tokens.where(wanted).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """'y idx:val ...' with indices from 1; what follows a # is a name -> id, y, idx, val (indices from 0), name."""
    body, name = F.trim(F.substring_index("value", "#", 1)), F.when(F.col("value").contains("#"), F.trim(F.substring_index("value", "#", -1)))
    p = F.split(body, r"\s+")
    pairs = F.transform(F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda x: x.contains(":")), lambda x: F.split(x, ":"))
    return lines(spark, path).where(body != "").select(
        F.col("pos").cast("long").alias("id"), p[0].cast("double").alias("y"), F.transform(pairs, lambda x: x[0].cast("int") - 1).alias("idx"), F.transform(pairs, lambda x: x[1].cast("double")).alias("val"), name.alias("name")
    )
