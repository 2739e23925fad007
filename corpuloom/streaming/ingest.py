"""Incremental ingestion: new document files to term counts, as an option beside the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuloom.operators import corpus as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come, at most so many a trigger."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def count_terms(docs: DataFrame, target: str, checkpoint: str, stopwords: tuple[str, ...] = (), n: int = 1, available: bool = True) -> StreamingQuery:
    """Append each batch's term counts to a table. A document comes once, so a batch's counts are final; a batch that
    is run again after a failure replaces its own part, which makes it exactly once."""
    def write(batch: DataFrame, number: int) -> None:
        C.term_counts(C.tokens(batch.select("doc_id", "text")), n, stopwords).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="30 seconds")).start()
