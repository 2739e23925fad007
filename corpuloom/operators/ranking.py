"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.session import Scratch


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with its rows' places, from 0, in an order that must be total.

    Rows are dealt by ranges of the order and written once (sampled bounds differ from run to run,
    so counts and rows must come from the same deal); the ranges' sizes, one row each, give where
    each begins, and ranks within a range are a window over it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = Scratch(spark, "rank").table(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    before = Window.orderBy("b_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy(F.col("_range").alias("b_range")).agg(F.count(F.lit(1)).alias("_n")).select("b_range", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        dealt.withColumn("_at", within)
        .join(F.broadcast(begins), F.col("_range") == F.col("b_range"))  # at most one row per partition
        .withColumn(name, F.col("_begin") + F.col("_at"))
        .drop("_range", "b_range", "_begin", "_at")
    )
