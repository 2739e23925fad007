"""Sharding by sampled splitters, in DataFrame operations only; the law is ``bytes``.

A record's key is a hash of its text, refined by one of its doc_id (of the row where that is null),
so equal texts are neighbours and a hot text can still be divided. Keys are drawn with a chance in
proportion to their record's size; quantiles of the sample are the splitters, which cut the keys
into ranges of about equal bytes. Ranges that turn out overfull are subdivided by quantiles of their
own keys, again and again until none is but those of a single key. Sums over the ranges tell
how many bytes lie before each range, sums within a range how many before each record, and a
record goes to the shard in which the middle of its bytes lies. So shards differ from equal sizes
by less than their two border records, and no task needs more than one range.

The first splitters are at most FIRST, which the plan holds; each subdivision gives up to FINER ranges
for one, so there are about as many ranges as ``rows_per_range`` asks for, at any number of rows. Rows that
share a key (one doc_id and one text, repeated) can't be told apart and make one range.

Defined results: a null text has no bytes (size 8). Rows that repeat each other get slots of their
own, in any order among themselves. Very long texts may make shards unequal by their own size.
Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm.common import own
from corpuloom.session import Scratch

LOW = (1 << 24) - 1
FIRST, FINER = 4096, 64


def _place(bounds: Column, key: Column, steps: int) -> Column:
    """How many of the sorted bounds are <= key, by bisection."""
    ranks = F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)])
    return F.aggregate(
        ranks, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at)
    )


def shard(spark: SparkSession, docs: DataFrame, shards: int = 24, rows_per_range: int = 20_000, draws: int = 64, overfull: float = 2.0) -> DataFrame:
    """A row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    who = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(2))).otherwise(F.xxhash64("doc_id", F.lit(1)))
    key = F.xxhash64(text).bitwiseAND(F.lit(~LOW)).bitwiseOR(who.bitwiseAND(F.lit(LOW)))
    rows = scratch.table(
        own(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")), "keys"
    )
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    total, n = whole["bytes"] or 1, whole["n"]
    wanted = max(shards * 2, -(-n // rows_per_range))
    ranges = min(FIRST, wanted)
    # Size-weighted draws: one chance in total / (draws * ranges) a byte; the draw itself is a hash, so reruns agree.
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(draws * ranges / total))
    drawn = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = rows.where(drawn).agg(F.percentile_approx("key", cuts, 100_000).alias("bounds"))
    bounds = sorted(set(bounds.first()["bounds"] or []))  # fewer than FIRST keys
    steps = max(1, len(bounds).bit_length())
    split = rows.withColumn("range", _place(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), F.col("key"), steps).cast("long"))
    split = scratch.table(split, "ranges-0")
    within = [i / FINER for i in range(1, FINER)]
    for level in count(1):
        # Overfull ranges that have two keys at least; each pass divides all of them, so few passes do.
        sizes = split.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        heavy = scratch.table(sizes.where((F.col("bytes") > overfull * total / wanted) & (F.col("low") < F.col("high"))).select(F.col("range").alias("h_range")), f"heavy-{level}")
        if not heavy.limit(1).count():
            break
        held = split.join(heavy, F.col("range") == F.col("h_range"), "left_semi")
        # the least key lies below every bound and the greatest is one, so each pass divides
        inner = held.groupBy(F.col("range").alias("i_range")).agg(F.percentile_approx("key", within, 10_000).alias("q"), F.min("key").alias("low"), F.max("key").alias("high"))
        inner = inner.select("i_range", F.array_sort(F.array_distinct(F.concat(F.filter("q", lambda x: x > F.col("low")), F.array("high")))).alias("inner"))
        inner = scratch.table(inner, f"inner-{level}")
        fine = F.when(F.col("inner").isNull(), F.lit(0)).otherwise(_place(F.col("inner"), F.col("key"), 7))
        split = scratch.table(
            split.join(inner, F.col("range") == F.col("i_range"), "left").withColumn("range", F.col("range") * (2 * FINER) + fine).drop("inner", "i_range"), f"ranges-{level}"
        )
    # One row per range: sums before each of them.
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        split.groupBy("range").agg(F.sum("size").alias("_bytes"))
        .select(F.col("range").alias("b_range"), F.coalesce(F.sum("_bytes").over(order), F.lit(0).cast("long")).alias("_begin"))
    )
    line = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size")
    upto = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    placed = split.withColumn("_upto", upto).join(begins, F.col("range") == F.col("b_range"))
    middle = F.col("_begin") + F.col("_upto") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int"))
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "key", "range", "shard"), "placed")
    # Slots: rows before this range in the shard, and before this row in the range.
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("shard").alias("c_shard"), F.col("range").alias("c_range"), F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long")).alias("_before"))
    )
    inner = Window.partitionBy("range", "shard").orderBy("key", "doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_at", F.row_number().over(inner))
        .join(counts, (F.col("shard") == F.col("c_shard")) & (F.col("range") == F.col("c_range")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
