"""The social network: adjacency to symmetric edges, joins on it, folds, non-edges, Q&A threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.operators.ranking import global_rank
from corpuloom.operators.users import hashed
from corpuloom.session import Scratch


def adjacency(lines: DataFrame, value: str = "value", sep: str = "\t") -> DataFrame:
    """'u f1 f2 ...' lines to (src, dst)."""
    parts = F.split(F.col(value), sep)
    return lines.select(F.get(parts, F.lit(0)).alias("src"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("dst"))


def symmetric(edges: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Both directions, once each, of edges whose ends are known users; no loops."""
    known = users.select(F.col(user).alias("_u")).distinct()
    kept = (
        edges.select("src", "dst").where(F.col("src") != F.col("dst"))
        .join(known, F.col("src") == F.col("_u"), "left_semi").join(known, F.col("dst") == F.col("_u"), "left_semi")
    )
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    back = edges.select(F.col("dst").alias("_s"), F.col("src").alias("_d")).distinct()
    return edges.join(back, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_semi").distinct()


def shared_items(posts: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Pairs a < b of users with an item in common, and how many."""
    bought = posts.select(user, item).distinct()
    left, right = bought.select(F.col(user).alias("a"), item), bought.select(F.col(user).alias("b"), item)
    return left.join(right, item).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges less those of ``gone``, in either direction."""
    both = gone.select("src", "dst").unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(both, ["src", "dst"], "left_anti")


def without_reverse_of(edges: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Drop the edges into the given users (the reverse ones of theirs)."""
    return edges.join(users.select(F.col(user).alias("dst")), "dst", "left_anti").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def edge_folds(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Folds of undirected edges, balanced within the smaller end; both directions have the fold of the edge."""
    once = edges.where(F.col("src") < F.col("dst"))
    w = Window.partitionBy("src").orderBy(hashed("src", "dst", seed=seed), "dst")
    folded = once.withColumn("fold", (F.row_number().over(w) - 1) % k)
    return folded.unionByName(folded.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fold"))


#: Draws of a task of non_neighbours(), about.
DRAWS = 2_000_000


def non_neighbours(edges: DataFrame, users: DataFrame, times: int = 2, seed: int = 0, tries: int = 8, user: str = "user_id") -> DataFrame:
    """Per user ``times`` * degree users that are neither themselves nor neighbours, or all of those where there are fewer.

    Candidates are drawn by a hash among the users' ranks, ``tries`` times as many as are wanted, and
    edges are taken out by an anti join, so all pairs of users are never made; users whose candidates
    run short draw on. A user who wants more than half of the strangers there are goes through all
    users instead, in order of a hash: those are at most 2 * times + 1 for each of its edges.

    Draws stay in the task that makes them, where the first want + degree different ones of a user are kept:
    no more than degree of them can be friends. So what is shuffled is a few rows per edge, and no table is
    broadcast: edges and users grow with the input, and files of ranks look far smaller than they are.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "strangers")
    ranked = scratch.table(global_rank(users.select(F.col(user).alias("_u")).distinct(), ["_u"], "_r"), "ranked")
    n = ranked.count()
    known = scratch.table(edges.select("src", "dst").distinct(), "known")
    want = degrees(edges).withColumn("_all", n - 1 - F.col("degree")).withColumn("want", F.least(F.col("degree") * times, F.col("_all")))
    own = ranked.select(F.col("_u").alias("src"), F.col("_r").alias("_own")).hint("merge")
    want = want.where("want > 0").join(own, "src", "left").select("src", "want", "_own", (F.col("want") + F.col("degree")).alias("_first"), (F.col("want") * 2 > F.col("_all")).alias("_dense"))
    want = scratch.table(want, "want")
    friends = known.join(ranked.select(F.col("_u").alias("dst"), "_r").hint("merge"), "dst").select("src", "_r")
    friends = scratch.table(friends, "friends")
    by_order = Window.partitionBy("src").orderBy("_order", "_r")  # ranks are in order of the users

    def strangers(rows: DataFrame, draws: Column, drawn) -> DataFrame:
        """The first ``want`` strangers of each src of rows, by draws (an array) that become ranks and orders: src, want, _r."""
        made = rows.agg(F.sum(F.size(draws).cast("long"))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-made // DRAWS))
        each = rows.repartition(tasks, "src").select("src", "want", "_own", "_first", F.explode(draws).alias("_draw"))
        each = drawn(each).where(~F.col("_r").eqNullSafe(F.col("_own")))
        first = each.groupBy("src", "_r").agg(F.min("_order").alias("_order"), F.first("want").alias("want"), F.first("_first").alias("_first"))
        first = first.withColumn("_at", F.row_number().over(by_order)).where(F.col("_at") <= F.col("_first"))
        found = first.join(friends.hint("merge"), ["src", "_r"], "left_anti")
        return found.withColumn("_at", F.row_number().over(by_order)).where(F.col("_at") <= F.col("want")).select("src", "want", "_r")

    ranks = F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))
    out = strangers(want.where("_dense"), ranks, lambda d: d.withColumnRenamed("_draw", "_r").withColumn("_order", hashed("src", "_r", seed=seed))).select("src", "_r")
    left, reach = want.where(~F.col("_dense")), tries
    while n:  # every pass draws again from the first try, twice as far
        draws = F.sequence(F.lit(1).cast("long"), F.col("want") * reach)
        got = strangers(left, draws, lambda d: d.withColumn("_r", hashed("src", "_draw", seed=seed) % n).withColumnRenamed("_draw", "_order"))
        got = scratch.table(got, f"drawn-{reach}")
        full = got.groupBy("src").agg(F.count(F.lit(1)).alias("_have"), F.first("want").alias("_want")).where(F.col("_have") == F.col("_want")).select("src").hint("merge")
        out = out.unionByName(got.join(full, "src", "left_semi").select("src", "_r"))
        left, reach = scratch.table(left.join(full, "src", "left_anti"), f"left-{reach}"), reach * 2
        if not left.limit(1).count():
            break
    return out.join(ranked.hint("merge"), "_r").select("src", F.col("_u").alias("dst"))


def answers(posts: DataFrame) -> DataFrame:
    """Per question (parent_id -1): post_id, user_id, n_answers, over answers to known questions."""
    questions = posts.where(F.col("parent_id") == -1).select("post_id", "user_id")
    counts = posts.where(F.col("parent_id") != -1).groupBy(F.col("parent_id").alias("post_id")).agg(F.count(F.lit(1)).alias("n_answers"))
    return questions.join(counts, "post_id", "left").withColumn("n_answers", F.coalesce("n_answers", F.lit(0)))


def answer_stats(posts: DataFrame, many: int = 5) -> DataFrame:
    n = F.col("n_answers")
    return answers(posts).agg(
        F.count(F.lit(1)).alias("n_questions"), F.count(F.when(n > 0, 1)).alias("n_answered"),
        F.count(F.when(n > many, 1)).alias("n_many"), F.avg(F.when(n > 0, n)).alias("avg_answers"),
    )


def selected_questions(posts: DataFrame, edges: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Questions of ``least`` to ``most`` answers whose asker is in the network and all of whose answerers have
    asked one; per question its answers by the asker's neighbours."""
    questions = posts.where(F.col("parent_id") == -1).select(F.col("post_id").alias("question"), F.col("user_id").alias("asker"))
    askers = questions.select(F.col("asker").alias("answerer")).distinct().withColumn("asks", F.lit(True))
    replies = posts.where(F.col("parent_id") != -1).select(F.col("parent_id").alias("question"), F.col("post_id").alias("answer"), F.col("user_id").alias("answerer"))
    joined = questions.join(replies, "question").join(askers, "answerer", "left")
    good = joined.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("asks", F.lit(False))).alias("all_ask")).where(F.col("n").between(least, most) & F.col("all_ask")).select("question")
    kept = joined.join(good, "question", "left_semi").join(edges.select(F.col("src").alias("asker")).distinct(), "asker", "left_semi")
    links = edges.select(F.col("src").alias("asker"), F.col("dst").alias("answerer")).distinct()
    return kept.join(links, ["asker", "answerer"], "left_semi").select("question", "asker", "answer", "answerer")


def answer_folds(posts: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with fold 0 if they answer one of the selected questions (question), else 1."""
    chosen = questions.select(F.col("question").alias("parent_id"), F.lit(0).alias("fold")).distinct()
    return posts.where(F.col("parent_id") != -1).join(chosen, "parent_id", "left").withColumn("fold", F.coalesce("fold", F.lit(1)))
