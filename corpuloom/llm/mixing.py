"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words; each of its documents is expected
target / source_size times. Documents of a source stand in order of size (which makes the words
taken come near the target), their expected copies are summed up to each of them, one random
offset per source is added, and a document is emitted once per integer boundary that the sum
crosses at it. Sums need each document's rank within its source: rows are dealt by ranges of
(source, size, doc_id), so a hot source spans many tasks, and counts per range and source, which
are few, say where each range begins.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an
empty source or a total of 0 has target 0 and nothing is taken. Rows that repeat each other take
ranks of their own. Reruns agree: the offset comes from the source's name and the seed. Extra
columns are ignored. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm.common import WORD, own
from corpuloom.session import Scratch

WEIGHTS = (5, 2, 1)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, limit: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> also weight and target: min(limit * size, level * weight) with one level for all.

    Sharing an excess again by weight until no target is above its limit ends at that level. It
    is found in order of limit / weight: a source is at its limit if all before it are and the
    level without it would be above its own.
    """
    at = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(at) - 1) % len(weights) + 1).cast("long")
    every = Window.partitionBy()
    rise = Window.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size") * limit
    shared = (
        sources.withColumn("weight", w)
        .withColumn("_full", full / F.col("weight"))
        .withColumn("_caps", F.coalesce(F.sum(full).over(rise), F.lit(0).cast("long")))
        .withColumn("_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rise), F.lit(0).cast("long")))
        .withColumn("_goal", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_level", (F.col("_goal") - F.col("_caps")) / F.col("_left"))
        # the level is that of the first source that isn't at its limit
        .withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", F.col("source").isNull().alias("n"), "source", "_level"))).over(every)["_level"])
    )
    capped = F.col("_final").isNull() | (F.col("_final") > F.col("_full"))
    return shared.select("source", "source_size", "weight", F.when(capped, full.cast("double")).otherwise(F.col("_final") * F.col("weight")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """Uniform in [0, 1), the same for a source in every run."""
    name = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(spark: SparkSession, docs: DataFrame, seed: str = "mix", share: float = 1.5, limit: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken, copies, source and the columns named in keep."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.table(own(docs, "doc_id", "text", "source", *keep).select("doc_id", "source", n_words().alias("size"), *keep), "sizes")
    sources = scratch.table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit), "sources")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source"), F.col("size"), F.col("doc_id").isNull(), F.col("doc_id")]
    dealt = scratch.table(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    # Ranges and sources meet in at most ranges + sources pairs.
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        dealt.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("source").alias("b_source"), F.col("_range").alias("b_range"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_begin"))
    )
    plan = begins.join(sources, F.col("b_source").eqNullSafe(sources["source"])).drop("source")
    within = Window.partitionBy("_range", "source").orderBy("size", F.col("doc_id").isNull(), "doc_id")
    ranked = dealt.withColumn("_at", F.row_number().over(within))
    joined = ranked.join(plan, ranked["source"].eqNullSafe(plan["b_source"]) & (ranked["_range"] == plan["b_range"]))
    rank = F.col("_begin") + F.col("_at")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = (F.floor(each * rank + u) - F.floor(each * (rank - 1) + u)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", *keep)
