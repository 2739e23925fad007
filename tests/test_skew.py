"""Joins on hot keys have an exchange of their own on both sides, without which Spark can't split them."""

from pyspark.sql import functions as F

from corpuloom.operators import weighting


def test_hot_term(spark):
    """A term of three quarters of all counts."""
    term = F.when(F.col("id") < 30_000, F.lit("the")).otherwise(F.concat(F.lit("t"), (F.col("id") % 977).cast("string")))
    counts = spark.range(40_000).select((F.col("id") % 20_000).alias("doc_id"), term.alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = weighting.with_stats(counts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        df = {r["term"]: r["df"] for r in found.select("term", "df").distinct().collect()}
        n = found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(reverse(term" in plan and "hashpartitioning(reverse(_term" in plan
    assert n == counts.count() and df["the"] == 20_000 and len(df) == 978


def test_dealt_by_size(spark, tmp_path):
    """Heavy work gets tasks by the size of its input, also where that lies in one row group."""
    from corpuloom.session import TASK_BYTES, dealt

    path = str(tmp_path / "one")
    spark.range(0, 2_000_000, numPartitions=1).selectExpr("id", "xxhash64(id) AS h").write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "one").glob("part-*"))
    assert size > 8 * TASK_BYTES and dealt(df).rdd.getNumPartitions() >= size // TASK_BYTES
    assert dealt(df).count() == 2_000_000
