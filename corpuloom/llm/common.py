"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.session import Scratch

#: Words and white space of the contracts, as Java and RE2 regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by place: extra ones can't clash with ours, not even by a name that differs in case only."""
    at = [df.columns.index(n) for n in names]
    placed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def row_digest(*names: str) -> Column:
    """A 64-bit digest of a row; with doc_id it tells rows apart unless they repeat each other."""
    return F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("\x00null")) for n in names])


def kept_schema(df: DataFrame, names: tuple[str, ...]) -> str:
    """The tail of a schema for columns that an operator hands through."""
    return "".join(f", `{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def keep_rows(docs: DataFrame, decided: DataFrame, key: str, copies: str) -> DataFrame:
    """docs, each row as many times as ``decided`` says.

    ``decided`` has doc_id, ``key`` (a digest column that ``docs`` has too) and ``copies`` for
    each row of ``docs``. Rows that repeat each other are counted, not told apart: they go
    through as one row that is emitted as often as all of them together. The counts are written,
    so ``decided`` runs once.
    """
    want = Scratch(docs.sparkSession, "kept").table(
        decided.groupBy(F.col("doc_id").alias("_want_id"), F.col(key).alias("_want_key"))
        .agg(F.sum(copies).cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")),
        "want",
    )
    repeated = want.agg(F.max("_rows")).first()[0] or 0
    columns = [c for c in docs.columns if c != key]
    if repeated > 1:
        docs = docs.dropDuplicates(["doc_id", key])
    joined = docs.join(
        want.where(F.col("_copies") > 0),
        docs["doc_id"].eqNullSafe(F.col("_want_id")) & (docs[key] == F.col("_want_key")),
    )
    many = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return joined.select(*[docs[c] for c in columns], many.alias("_copy")).drop("_copy")
