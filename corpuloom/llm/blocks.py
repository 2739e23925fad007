"""Comparing the members of buckets, in blocks of bounded size.

Members come as rows with a bucket key. A bucket of more than ``block`` members is cut into
sub-blocks by a hash of the member, and every pair of sub-blocks becomes a bucket of its own, so
no task holds more than two sub-blocks and every pair of members still meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, key: list[str], member: str, block: int) -> DataFrame:
    """rows with columns _i, _j and _side: the pair of sub-blocks a row stands for and its side in it.

    Buckets of one member are dropped: nothing meets there.
    """
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    parts = F.ceil(F.col("_n") / block).cast("int")
    sub = F.pmod(F.xxhash64(member), parts).cast("int")
    whole = rows.join(sizes, cond).withColumn("_parts", parts).withColumn("_sub", sub)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda o: F.struct(F.least("_sub", o).alias("_i"), F.greatest("_sub", o).alias("_j"), F.when(F.col("_sub") <= o, 0).otherwise(1).alias("_side")),
    )
    return whole.select(*rows.columns, F.inline(pairs))


def streamed(batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 20_000):
    """Calls work on tables of whole buckets. The batches must be sorted by the key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.zeros(table.num_rows, bool)
        for k in key:
            v = table.column(k).to_numpy()
            last |= v != v[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield from work(table.slice(0, cut))
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def runs(table: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the buckets in a sorted table."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in key:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], table.num_rows)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges between places, some that connect as much as all of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept
