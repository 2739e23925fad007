"""Alignment of two tokenizers over the same bytes, and how often their ids meet.

A text is encoded twice, a space before it: by a byte-level BPE (A) and by a piece model with byte
fallback (B, which puts that space itself). Where a token of A and one of B end at the same byte is
a cut; the cuts divide both lists into groups. A link is a pair of token occurrences, one of A and
one of B, whose byte ranges end together (``links="end"``: one per cut), or that lie in one group
(``links="group"``: each of A with each of B there). Ends are running sums of the tokens' byte
lengths, cuts their intersection, groups a binary search, and links an expansion by repeats, for a
whole batch of texts at once: a text ends both lists, so it ends a group as well.

Each text is encoded once. Its distinct id pairs go to a table with the text's other results; the
corpus-wide count of a pair is added up there, within salted parts and then over them, so a pair
that half of the texts hold is no task's burden. The counts come back to the texts by a join: as a
broadcast while there are at most ``most_pairs`` of them (24 bytes each), by a shuffle that Spark
can split beyond that.

Defined results: texts that are null or empty, and those that a tokenizer does not give back byte
by byte (U+2581, which B takes for a space), have no tokens: zeros and an empty string. Strings of
special tokens inside a text are plain text. Rows that repeat each other are counted each. Texts of
any length go through whole. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import Scratch, ship

#: Pairs (24 bytes each) up to which their counts are broadcast.
MOST_PAIRS = 2_000_000
SALTS = 16
BYTES = 1 << 20  # of the texts encoded at once, unless one has more

_TABLE = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_loaded: dict[tuple[str, str], "Both"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes bytes with: printable ones as they are, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """For each id its bytes, their number, and its decimal text with each separator that may follow."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = np.array([*tokens, b""], object)[:-1]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.written = np.array([[f"{i}{end}" for end in (",", "|", ";")] for i in range(len(tokens))], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


def ranked(told: dict, tokens: list[bytes], letters: dict[str, int]):
    """The same byte-level BPE for tiktoken, which takes a quarter of the time, or None where it wouldn't be the same.

    It is the same where nothing normalizes, the usual pattern splits, and ids rise with the order of the merges.
    """
    import public_tokenizers
    import tiktoken

    before, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain:
        return None
    ranks = {t: i for i, t in enumerate(tokens) if t}
    joined = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [ranks[bytes(map(letters.__getitem__, x + y))] for x, y in joined]
    single = [ranks.get(bytes([x]), len(ranks)) for x in range(256)]
    if order != sorted(set(order)) or max(single) >= min(order, default=len(ranks)) or len(ranks) != 256 + len(order):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Both:
    """The two tokenizers."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(a, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["id"] for t in told["added_tokens"]}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_words = Vocabulary([t.encode() if i in special else bytes(map(letters.__getitem__, t)) for i, t in enumerate(entries)])
        self.a_ranks = ranked(told, [b"" if i in special else t for i, t in enumerate(self.a_words.tokens)], letters)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_words = Vocabulary([bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces])

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where a tokenizer doesn't give the text back, or there is none."""
        plain = [t.decode() for t in texts]
        if self.a_ranks is not None:
            a = [np.array(self.a_ranks.encode_ordinary(" " + t), np.int64) for t in plain]
        else:
            a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in plain], add_special_tokens=False)]
        b = [np.array(ids, np.int64) for ids in self.b.encode(plain, num_threads=1)]
        for i, text in enumerate(texts):
            if not text or self.a_words.joined(a[i]) != b" " + text or self.b_words.joined(b[i]) != b" " + text:
                a[i] = b[i] = np.empty(0, np.int64)
        return a, b


def both(a: str, b: str) -> Both:
    if (a, b) not in _loaded:
        _loaded[a, b] = Both(a, b)
    return _loaded[a, b]


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte lengths of two lists of tokens over the same bytes -> the cuts, and the group of each token of A and of B."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def expand(group_a: np.ndarray, group_b: np.ndarray, n_groups: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the links of all groups: the last tokens of each, or each of A with each of B."""
    last_a, last_b = np.searchsorted(group_a, np.arange(n_groups), "right"), np.searchsorted(group_b, np.arange(n_groups), "right")
    n_a, n_b = (np.diff(x, prepend=0) for x in (last_a, last_b))
    if how == "end":  # only the last ones end where the other list has an end too
        n_a, n_b = np.ones_like(n_a), np.ones_like(n_b)
    links = n_a * n_b
    group = np.repeat(np.arange(n_groups), links)
    at = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    return (last_a - n_a)[group] + at // n_b[group], (last_b - n_b)[group] + at % n_b[group]


def _written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tools: Both) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The decimal ids with their separators in the order of the groups, A before B, and where each token of A and of B stands."""
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    out = np.empty(len(ids_a) + len(ids_b), object)
    last = lambda group: np.append(group[1:] != group[:-1], True)[: len(group)].astype(int)
    out[place_a] = tools.a_words.written[ids_a, last(group_a)]
    out[place_b] = tools.b_words.written[ids_b, 2 * last(group_b)]
    return out.tolist(), place_a, place_b


def _held(batches):
    """(_row, doc_id, text) in lists of few texts and bytes."""
    held, size = [], 0
    for batch in batches:
        for row, doc_id, raw in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), K.texts(batch.column("text"))):
            if held and (size + len(raw or b"") > BYTES or len(held) == 256):
                yield held
                held, size = [], 0
            held.append((row, doc_id, raw or b""))
            size += len(raw or b"")
    if held:
        yield held


def _aligned(batches, a: str, b: str, links: str):
    tools = both(a, b)
    wide = len(tools.b_words.sizes)
    for held in _held(batches):
        each_a, each_b = tools.encode([t for _, _, t in held])
        ids_a, ids_b = np.concatenate(each_a), np.concatenate(each_b)
        n_a, n_b = (np.array([len(x) for x in each], np.int64) for each in (each_a, each_b))
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        cuts, group_a, group_b = align(tools.a_words.sizes[ids_a], tools.b_words.sizes[ids_b])
        first_group = np.searchsorted(group_a, np.arange(len(cuts)))
        link_a, link_b = expand(group_a, group_b, len(cuts), links)
        # texts of the groups and links, by the places of their first tokens
        group_ends = np.searchsorted(first_group, ends_a)
        link_ends = np.searchsorted(link_a, ends_a)
        pair = ids_a[link_a] * wide + ids_b[link_b]
        written, _, _ = _written(ids_a, ids_b, group_a, group_b, tools)
        rows = []
        for i, (row, doc_id, _) in enumerate(held):
            start_a, start_b = int(ends_a[i] - n_a[i]), int(ends_b[i] - n_b[i])
            told = "".join(written[start_a + start_b : int(ends_a[i] + ends_b[i])])[:-1]
            mine = slice(int(link_ends[i - 1]) if i else 0, int(link_ends[i]))
            pairs, times = np.unique(pair[mine], return_counts=True)
            n_groups = int(group_ends[i]) - (int(group_ends[i - 1]) if i else 0)
            rows.append((row, doc_id, int(n_a[i]), int(n_b[i]), n_groups, mine.stop - mine.start, hashlib.sha256(told.encode()).hexdigest() if n_a[i] else "", pairs, times))
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _TABLE.split(", ")])


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """_pair, _count: how many links of the whole table hold each pair of ids; added up within salted parts first."""
    each = aligned.select(F.pmod("_row", F.lit(salts)).alias("_salt"), F.explode(F.arrays_zip("pairs", "times")).alias("_x"))
    parts = each.groupBy(F.col("_x.pairs").alias("_pair"), "_salt").agg(F.sum("_x.times").alias("_count"))
    return parts.groupBy("_pair").agg(F.sum("_count").alias("_count"))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    if a is None or b is None:
        import public_tokenizers

        a, b = a or str(public_tokenizers.path("byte_bpe_50k.json")), b or str(public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def pairs_of(spark: SparkSession, docs: DataFrame, a: str | None = None, b: str | None = None, links: str = "end") -> tuple[DataFrame, DataFrame, int]:
    """The written table of aligned texts, the written table of pairs (a_id, b_id, count, best: the greatest count of that b_id), and the pairs' number."""
    if links not in ("end", "group"):
        raise ValueError("links are 'end' or 'group'")
    ship(spark)
    a, b = _paths(a, b)
    scratch = Scratch(spark, "alignment")
    rows = own(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    aligned = scratch.table(rows.mapInArrow(partial(_aligned, a=a, b=b, links=links), _TABLE), "aligned")
    wide = len(both(a, b).b_words.sizes)
    counts = scratch.table(pair_counts(aligned), "counts")
    most = counts.groupBy((F.col("_pair") % wide).alias("_b")).agg(F.max("_count").alias("best"))
    pairs = counts.join(F.broadcast(most), F.col("_pair") % wide == F.col("_b"))  # a row per id of B's vocabulary at most
    pairs = scratch.table(pairs.select("_pair", F.floor(F.col("_pair") / wide).alias("a_id"), F.col("_b").alias("b_id"), F.col("_count").alias("count"), "best"), "pairs")
    return aligned, pairs, pairs.count()


def align_tokenizers(
    spark: SparkSession, docs: DataFrame, a: str | None = None, b: str | None = None, links: str = "end", most_pairs: int = MOST_PAIRS
) -> DataFrame:
    """A row per row of docs (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair's count is the highest of their id of B; count_sum: the counts of all its links added up.
    """
    aligned, pairs, n_pairs = pairs_of(spark, docs, a, b, links)
    known = pairs.select("_pair", "count", (F.col("count") == F.col("best")).alias("_is_best"))
    each = aligned.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_x")).select("_row", F.col("_x.pairs").alias("_held"), F.col("_x.times").alias("_times"))
    sums = (
        each.join(F.broadcast(known) if n_pairs <= most_pairs else known.hint("merge"), F.col("_held") == F.col("_pair"))
        .groupBy(F.col("_row").alias("_of"))
        .agg(F.sum(F.when(F.col("_is_best"), F.col("_times")).otherwise(0)).alias("n_best"), F.sum(F.col("_times") * F.col("count")).alias("count_sum"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs", "times").join(sums, F.col("_row") == F.col("_of"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
