"""The registered queries of this package: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuloom.llm import alignment, credentials, exact, langid, mixing, packing, periodic, sharding, simhash, substring, tokencount, vectors, warc
from corpuloom.llm.oracles import ORACLES
from corpuloom.session import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(spark, read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(spark, read_table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read_table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(spark, read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(spark, read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, read_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(spark, read_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(spark, read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(spark, read_table(spark, sf_dir, "documents"), loops=True)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(spark, read_table(spark, sf_dir, "documents"))


def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_substring_dedup, op3_exact_dedup, op4_source_mix, op5_simhash_dedup, op6_packing,
        op7_token_counts, op8_sharding, op9_embedding_dedup, op10_language_id, op11_periodic_runs, op12_tokenizer_alignment,
        op13_warc_transactions, pipeline,
    )
}

__all__ = ["ORACLES", "QUERIES"]
