"""Packing token sequences by cutting-stock column generation.

Documents are tokenized and end with one separator. A document longer than a sequence is cut into
full sequences and a rest. Rests are counted in a histogram of lengths in steps of ``grain``
tokens. A linear program covers the histogram with patterns (how many pieces of each length fill
one sequence): it starts with the patterns of a single length, its dual prices value the lengths,
and a knapsack dynamic program finds the pattern of the greatest value, until none is worth more
than one sequence. Rounded down, the patterns leave few pieces of each length, which are packed
first-fit decreasing into patterns of their own. Pieces are ranked within their length, and their
rank says pattern, sequence and place. Everything the driver holds is bounded by the number of
lengths (capacity / grain); ranks come from ranges, so a length may have any number of pieces.

Defined results: a null or empty text is one separator. Rows that repeat each other are packed as
rows of their own. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import Scratch, ship

CAPACITY, GRAIN, SEPARATOR = 2048, 16, 1
#: Words kept in each of two generations.
CACHE = 400_000
#: Lower-case letters of one code point each, alike in every Unicode form.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: What ASCII text is cut into, lower-cased and without apostrophes, which begin contractions.
_RUNS = re.compile(b"[a-z]+|[0-9]|[^a-z0-9]+")
_TAIL = string.punctuation.encode()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
_coders: dict[str, "Words"] = {}


class Words(dict):
    """Token ids of words, as little-endian 32-bit bytes.

    Where the tokenizer lower-cases, cuts at white space and then into runs of letters, single
    digits and runs of the rest, a text's ids are those of its words in a row, so words are looked
    up; a word of letters alone goes straight to the tokenizer's model, and punctuation behind it is
    a piece of its own; other ASCII words are put together from their runs. Words not met since the
    last but one generation began are forgotten, so common ones stay known however many rare ones
    come. Special tokens are found in raw text: texts that hold "<|" go through whole, as do all
    texts of tokenizers of another build.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": pattern}
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        )

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_letters(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece)
        if len(tokens) < len(_PACK):
            return _PACK[len(tokens)](*[t.id for t in tokens])
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(_TAIL)
            if core.isalpha():  # ASCII letters, of the bytes
                ids = self._of_letters(core.decode().lower()) if core == word else self[core] + self[word[len(core) :]]
            elif core and _LETTERS.fullmatch(lower := core.decode().lower()):
                ids = self._of_letters(lower.encode().decode("latin-1").translate(_BYTES)) if core == word else self[core] + self[word[len(core) :]]
            elif core and word.isascii() and b"'" not in word and len(runs := _RUNS.findall(word.lower())) > 1:
                ids = b"".join(map(self.__getitem__, runs))
            else:
                ids = self._encoded(word.decode())
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if not self.by_word or b"<|" in text:
            return self._encoded(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))


def coder(path: str) -> Words:
    if path not in _coders:
        _coders[path] = Words(path)
    return _coders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _pieces(batches, path: str, capacity: int, separator: int, with_ids: bool):
    words = coder(path)
    end = np.array([separator], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    for batch in K.bounded(batches):
        rows: list[list] = [[] for _ in names]
        for doc, text in zip(batch.column("doc_id").to_pylist(), K.texts(batch.column("text"))):
            ids = words.encode(text or b"") + end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                for column, value in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece)):
                    column.append(value)
        types = [pa.int64()] * 5 + [pa.binary()] * with_ids
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)


def knapsack(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths 1..len(value) of at most ``units`` in total that is worth most."""
    best = np.zeros(units + 1)
    taken = np.zeros(units + 1, int)
    for u in range(1, units + 1):
        fit = min(u, len(value))
        options = value[:fit] + best[u - 1 :: -1][:fit]
        k = int(np.argmax(options))
        best[u], taken[u] = (options[k], k + 1) if options[k] > best[u - 1] + 1e-12 else (best[u - 1], 0)
    pattern, u = np.zeros(len(value), int), units
    while u > 0:
        if taken[u]:
            pattern[taken[u] - 1] += 1
            u -= taken[u]
        else:
            u -= 1
    return float(best[units]), pattern


def patterns(demand: np.ndarray, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns over lengths of 1..units grains and how many sequences take each, covering demand exactly."""
    units = len(demand)
    active = np.flatnonzero(demand)
    if not len(active):
        return []
    columns = [np.where(np.arange(units) == k, units // (k + 1), 0) for k in active]
    basis = np.array(columns, float).T[active]
    b = demand[active].astype(float)
    x = np.linalg.solve(basis, b)
    for _ in range(rounds):
        prices = np.zeros(units)
        prices[active] = np.linalg.solve(basis.T, np.ones(len(active)))
        worth, pattern = knapsack(np.where(demand > 0, prices, 0), units)
        if worth <= 1 + 1e-9:
            break
        d = np.linalg.solve(basis, pattern[active].astype(float))
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = pattern
        basis[:, out] = pattern[active]
        x = np.maximum(np.linalg.solve(basis, b), 0)
    plan, left = [], demand.astype(int).copy()
    for count, pattern in sorted(zip(x.tolist(), columns), key=lambda p: -p[0]):
        held = np.flatnonzero(pattern)
        n = min(int(count + 1e-9), *(int(left[k] // pattern[k]) for k in held))
        if n > 0:
            plan.append((np.asarray(pattern, int), n))
            left = left - n * pattern
    # What rounding left, first-fit decreasing; equal sequences of it are counted, not listed.
    bins: list[tuple[int, np.ndarray]] = []
    while left.any():
        room, pattern = units, np.zeros(units, int)
        for k in range(units - 1, -1, -1):
            take = min(int(left[k]), room // (k + 1))
            pattern[k], room = take, room - take * (k + 1)
        n = min(int(left[k] // pattern[k]) for k in np.flatnonzero(pattern))
        bins.append((n, pattern))
        left = left - n * pattern
    return plan + [(p, n) for n, p in bins]


def pack(
    spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, separator: int = SEPARATOR, with_ids: bool = False
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (its sequence's) and, if asked for, ids."""
    ship(spark)
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = own(docs, "doc_id", "text").mapInArrow(
        partial(_pieces, path=path or vocabulary(), capacity=capacity, separator=separator, with_ids=with_ids), schema
    )
    pieces = scratch.table(pieces.withColumn("units", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    units = capacity // grain
    demand = np.zeros(units, int)
    for row in pieces.groupBy("units").count().collect():  # at most capacity / grain rows
        demand[row["units"] - 1] = row["count"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["units", "length", "ids_crc32", "doc_id", "start"]
    dealt = scratch.table(pieces.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("units").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        dealt.groupBy("units", "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("units").alias("b_units"), F.col("_range").alias("b_range"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_begin"))
    )
    ranked = (
        dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range", "units").orderBy(*order[1:])) - 1)
        .join(begins, (F.col("units") == F.col("b_units")) & (F.col("_range") == F.col("b_range")))
        .withColumn("_rank", F.col("_begin") + F.col("_at"))
    )
    # Where each length's ranks begin in each pattern: at most lengths x patterns rows, both bounded by capacity / grain.
    table, sequence, used = [], 0, np.zeros(units, int)
    for pattern, n in patterns(demand):
        for k in np.flatnonzero(pattern).tolist():
            table.append((k + 1, int(used[k]), int(used[k] + pattern[k] * n), int(pattern[k]), sequence))
            used[k] += pattern[k] * n
        sequence += n
    lookup = spark.createDataFrame(table, "l_units int, first long, last long, each long, sequence long")
    lookup = lookup.groupBy("l_units").agg(F.sort_array(F.collect_list(F.struct("first", "last", "each", "sequence"))).alias("runs"))
    placed = ranked.join(F.broadcast(lookup), F.col("units") == F.col("l_units"))
    run = F.filter("runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["last"]))[0]
    placed = (
        placed.withColumn("_run", run)
        .withColumn("sequence_id", F.col("_run.sequence") + F.floor((F.col("_rank") - F.col("_run.first")) / F.col("_run.each")).cast("long"))
        .withColumn("_slot", (F.col("_rank") - F.col("_run.first")) % F.col("_run.each"))
    )
    here = Window.partitionBy("sequence_id")
    line = here.orderBy(F.desc("units"), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum("length").over(here)
    exempt = F.bit_count(filled) == 1
    ids = ["ids"] * with_ids
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(line), F.lit(0).cast("long")).alias("offset"),
        F.when(exempt, filled).otherwise(F.lit(capacity).cast("long")).alias("padded"),
        *ids,
    )
