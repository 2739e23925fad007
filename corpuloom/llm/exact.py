"""Exact dedup by content-defined chunk recipes.

Texts are compared after deleting white space. Each text is cut where a rolling hash of its
last 32 bytes says so, which makes its recipe: the ordered list of its chunks' identifiers. A
chunk's identifier is a 64-bit hash that is verified: over all chunks, those that share an
identifier are checked to have the same bytes, once per distinct chunk of a task. Texts are then
equal when their lists are; whole documents are never moved. Should two chunks collide, documents
with such a chunk are told apart by their SHA-256 as well.

Defined results: a null text counts as empty, and empty texts are equal. Of equal texts the row
with the most code points in its original text stays, then the smallest doc_id (null last); of
rows that tie in both, one stays. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import kept_schema, own
from corpuloom.session import Scratch, ship

DROP = b"\x20\x09\x0a\x0b\x0c\x0d"
WIDTH, LEAST, AVERAGE, MOST = 32, 512, 2048, 16384


def cuts(text: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of the chunks. A cut depends on the 32 bytes before it and on the cut before."""
    if len(text) <= LEAST:
        return [len(text)] if text else []
    marks = []
    for at in range(0, len(text), 1 << 20):  # in blocks that overlap by the width of the hash
        data = np.frombuffer(text, np.uint8)[max(0, at - WIDTH) : at + (1 << 20)]
        ends = np.arange(WIDTH, len(data) + 1)
        if len(ends):
            h = K.spans(data, ends - WIDTH, ends, K._BYTE, K._ODD[0])
            marks.append(ends[(h & K.U64(average - 1)) == 0] + max(0, at - WIDTH))
    out, last = [], 0
    for m in np.concatenate(marks).tolist() if marks else []:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            last = m
            out.append(last)
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(text):
        out.append(len(text))
    return out


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _normal(batch: pa.RecordBatch):
    for raw in K.texts(batch.column("text")):
        yield raw or b"", (raw or b"").translate(None, DROP)


def _recipes(batches, keep: tuple[str, ...]):
    for batch in K.bounded(batches):
        lists, shas, points = [], [], []
        for raw, text in _normal(batch):
            lists.append([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in chunks(text)])
            shas.append(hashlib.sha256(text).hexdigest())
            points.append(len(raw.decode()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(shas, pa.string()), pa.array(points, pa.int64()), *[batch.column(k) for k in keep]],
            ["doc_id", "recipe", "text_sha256", "n_points", *keep],
        )


def _contents(batches):
    for batch in K.bounded(batches):
        seen: dict[bytes, int] = {}
        for _, text in _normal(batch):
            for c in chunks(text):
                if c not in seen:
                    seen[c] = xxhash.xxh3_64_intdigest(c) - (1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())], ["chunk", "content"])


def dedup(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks and the columns named in keep."""
    ship(spark)
    scratch = Scratch(spark, "exact")
    rows = scratch.table(
        own(docs, "doc_id", "text", *keep)
        .mapInArrow(partial(_recipes, keep=keep), "doc_id long, recipe array<long>, text_sha256 string, n_points long" + kept_schema(docs, keep))
        .withColumn("_row", F.monotonically_increasing_id()),
        "recipes",
    )
    # Identifiers are verified: equal least and greatest content under one identifier.
    collided = (
        own(docs, "text").mapInArrow(_contents, "chunk long, content binary")
        .groupBy("chunk")
        .agg(F.min("content").alias("least"), F.max("content").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("chunk")
    )
    collided = scratch.table(collided, "collided")
    key = F.lit("")
    if collided.limit(1).count():
        doubted = rows.select("_row", F.explode("recipe").alias("chunk")).join(collided, "chunk", "left_semi").select("_row").distinct()
        rows = rows.join(doubted.withColumn("_doubted", F.lit(True)), "_row", "left")
        key = F.when(F.col("_doubted"), F.col("text_sha256")).otherwise(F.lit(""))
    rows = rows.withColumn("_key", key)
    best = F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = (
        rows.groupBy(F.col("recipe").alias("g_recipe"), F.col("_key").alias("g_key"))
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
        .where(F.col("group_size") > 1)
    )
    joined = rows.join(groups, (rows["recipe"] == groups["g_recipe"]) & (rows["_key"] == groups["g_key"]), "left")
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("_row"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
        *keep,
    )
