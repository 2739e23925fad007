"""A training-data pipeline: language ID, exact dedup, near dedup, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
run() applies them to documents, writing each result as Parquet to the shared folder and reading
it again. All stages but the last return the columns of documents. Rows are told apart by doc_id
and a digest of the row; rows that repeat each other are counted, so exact dedup keeps one of them.
Near copies are documents of a Jaccard similarity of 0.8 or more in five-word shingles: fingerprints find
them and the shingles verify them; they form groups, of which one document stays.

Defined results: a null text, an empty one or one without a letter goes in language ID. Nulls in
other columns are values like any other (a null source is a source of its own, a null doc_id comes
last among equals and is no one's copy by itself). Of tied rows one stays. Long texts go through
whole. Extra columns, whatever their names, are left out. An empty table gives an empty table of
the last stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import exact, langid, mixing, packing, simhash
from corpuloom.llm.common import keep_rows, own, row_digest
from corpuloom.session import Scratch, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL has neither the trained model nor XXH64 nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letter, or a score below the calibrated one) go."""
    docs = own(docs, *COLUMNS)
    return langid.identify(spark, docs, langid.fit(spark, docs)).where(~F.col("_rejected")).select(*COLUMNS)


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """decided: doc_id, _digest and _copies of each row of docs."""
    return keep_rows(docs, decided, "_digest", "_copies").select(*COLUMNS)


def _digested(docs: DataFrame) -> DataFrame:
    return own(docs, *COLUMNS).withColumn("_digest", row_digest(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    docs = _digested(docs)
    return _kept(docs, exact.dedup(spark, docs, keep=("_digest",)).withColumn("_copies", F.col("kept").cast("int")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8) stays."""
    docs = _digested(docs)
    return _kept(docs, simhash.near_dedup(spark, docs, shingle=5, similarity=0.8, keep=("_digest",)).withColumn("_copies", F.col("kept").cast("int")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it."""
    docs = _digested(docs)
    return _kept(docs, mixing.mix(spark, docs, keep=("_digest",)).withColumn("_copies", F.col("copies").cast("int")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
