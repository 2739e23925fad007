"""The user and item layer: ratings, splits by time, folds, strata, recommendation seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binarized(posts: DataFrame, neutral: int = 3, positive: int = 4) -> DataFrame:
    """posts without neutral ratings, y = 1 from ``positive`` on."""
    return posts.where(F.col("rating") != neutral).withColumn("y", (F.col("rating") >= positive).cast("int"))


def at_least(posts: DataFrame, n: int = 2, user: str = "user_id") -> DataFrame:
    """posts of users with n of them or more, with ord: the place in the user's order."""
    w = Window.partitionBy(user)
    return posts.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= n).drop("_n")


def time_split(posts: DataFrame, order: list[str], train: float = 0.25, adapt: float = 0.5, enforce: bool = False, user: str = "user_id") -> DataFrame:
    """Per user in order of time: the first floor(n train) TRAIN, up to floor(n (train + adapt)) ADAPTATION, then TEST.

    With enforce at least one post is ADAPTATION.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    at = F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1
    first, upto = F.floor(n * train), F.floor(n * (train + adapt))
    if enforce:
        upto = F.greatest(upto, first + 1)
    split = F.when(at < first, "TRAIN").when(at < upto, "ADAPTATION").otherwise("TEST")
    return posts.withColumn("ord", at).withColumn("split", split)


def first_per_item(posts: DataFrame, order: list[str], user: str = "user_id", item: str = "item_id") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(user, item).orderBy(*order))
    return posts.withColumn("_at", at).where(F.col("_at") == 1).drop("_at")


def train_test_items(posts: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """ADAPTATION posts train, all others test; of a user's posts on one item the last in order counts."""
    part = F.when(F.col("split") == "ADAPTATION", "train").otherwise("test")
    return posts.withColumn("part", part).groupBy(user, item, "part").agg(F.max_by("rating", "ord").alias("rating"))


def recommendation_seeds(posts: DataFrame, order: list[str], more_than: int = 5, most: int = 10, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Items with more_than < posts <= most: the earliest post is the item's seed; a user keeps one seed."""
    per = Window.partitionBy(item)
    n = F.count(F.lit(1)).over(per)
    at = F.row_number().over(per.orderBy(*order, user))
    seeds = posts.withColumn("n_posts", n).withColumn("_at", at).where((F.col("n_posts") > more_than) & (F.col("n_posts") <= most) & (F.col("_at") == 1))
    one = F.row_number().over(Window.partitionBy(user).orderBy(*order, item))
    return seeds.withColumn("_one", one).where(F.col("_one") == 1).drop("_one", "_at")


def stratum(n: Column, light: int, medium: int) -> Column:
    """heavy above ``medium``, medium above ``light``, else light."""
    return F.when(n > medium, "heavy").when(n > light, "medium").otherwise("light")


def hashed(*columns: str, seed: int = 0) -> Column:
    """A pseudo-random order of integer keys that SQL can say too; the same in every run."""
    h = F.lit(seed).cast("long")
    for c in columns:
        h = (h * 31 + F.col(c).cast("long") * 40503 + 12345) % 2147483647
        h = (h * 48271) % 2147483647
    return h


def balanced_folds(rows: DataFrame, k: int, group: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Folds of sizes at most one apart within a group, in a seeded order."""
    w = Window.partitionBy(group).orderBy(hashed(*keys, seed=seed), *keys)
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % k)


def random_folds(rows: DataFrame, k: int, keys: list[str], seed: int = 0) -> DataFrame:
    return rows.withColumn("fold", (hashed(*keys, seed=seed) % k).cast("int"))


def held_out(rows: DataFrame, fold: int) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("fold") == fold, "TEST").otherwise("TRAIN"))


def sampled(rows: DataFrame, group: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group, without replacement."""
    w = Window.partitionBy(group).orderBy(hashed(*keys, seed=seed), *keys)
    return rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def runs(rows: DataFrame, order: list[str], value: str, over: str | None = None) -> DataFrame:
    """rows with run: the number of the run of equal values, in order (within ``over``)."""
    w = Window.partitionBy(over).orderBy(*order) if over else Window.orderBy(*order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w)).drop("_c")


def profile_similarity(profiles: DataFrame, pairs: DataFrame, key: str, value: str = "tf") -> DataFrame:
    """pairs (a, b) with the cosine of their profiles; 0 if a norm is 0 or nothing is shared."""
    norms = profiles.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    left = profiles.select(F.col(key).alias("a"), "term", F.col(value).alias("va"))
    right = profiles.select(F.col(key).alias("b"), "term", F.col(value).alias("vb"))
    dots = pairs.select("a", "b").join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na, nb = norms.select(F.col(key).alias("a"), F.col("norm").alias("na")), norms.select(F.col(key).alias("b"), F.col("norm").alias("nb"))
    joined = pairs.join(dots, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left")
    size = F.col("na") * F.col("nb")
    return joined.select("a", "b", F.coalesce(F.when(size > 0, F.col("dot") / size), F.lit(0.0)).alias("cosine"))
