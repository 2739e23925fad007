"""Substring dedup with repeated-phrase automata.

A passage is ``window`` consecutive words. Phrases are its ``phrase``-word runs; of every window
the phrase with the least hash is its anchor, so two documents that share a window share its
anchor. The steps:

1. Each document gives its anchors and the SHA-256 of its words. Documents with the same words
   are one class, stood for by the least doc_id; anchors are gathered from those alone.
2. Phrases that are anchors in two documents or more recur: an aggregation over all anchors
   confirms them and finds the least document that holds each, its owner.
3. Owners give the words of their recurring phrases. The phrases of the same owners, which mostly
   occur together, make a shard of bounded size, for which one Aho-Corasick automaton is compiled.
   Every document is streamed through the automata of the shards that hold a phrase of its;
   others have none to locate. The automaton compares text, so it locates every occurrence of a
   phrase and nothing else. A shard of very many documents is cut into parts that each compile it.
4. Windows whose anchor was located give a fingerprint each: 128 bits of BLAKE2b over their words,
   joined by one blank each. An aggregation over the fingerprints confirms the windows that recur and finds
   the least doc_id of each; documents get back the places of theirs that start in a smaller one,
   and drop the words that those cover.

Two different windows are taken for equal only if BLAKE2b collides on 128 bits; no such inputs are
known, whatever the texts. Other hashes only choose anchors.

Defined results: a null text has no words. A document with a null doc_id comes after all others,
the greatest doc_id included; documents of the same doc_id don't remove from each other, as neither
is smaller. Rows that repeat each other give one row each. A long text is one row of words: its
memory is some 20 times its bytes in one task. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import Scratch, ship

#: Phrases that an automaton has at most, but for those of one owner; bytes of text that one part of a shard streams, about.
SHARD_PHRASES, PART_BYTES = 10_000, 2 << 20


def anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes, the least of each window, and which phrases are some window's least."""
    g = K.grams(h, phrase)
    span = window - phrase + 1
    least = K.sliding(g, span)
    if not len(least):
        return g, least, np.zeros(len(g), bool)
    edge = np.zeros(span - 1, K.U64)
    reach = K.sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    # reach is the greatest window minimum around a phrase; a phrase that equals one is an anchor
    return g, least, reach == g


def _signatures(batches, window: int, phrase: int):
    for batch in K.bounded(batches):
        n, sha, found = [], [], []
        for raw in K.texts(batch.column("text")):
            words = (raw or b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
            g, _, is_anchor = anchors(K.word_hashes(words), window, phrase) if len(words) >= window else (np.empty(0, K.U64), None, np.zeros(0, bool))
            found.append(K.signed(np.unique(g[is_anchor])))
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
            ["doc_id", "n_words", "sha", "anchors"],
        )


def _phrases(batches, window: int, phrase: int):
    """The words of the recurring phrases that a document owns."""
    for batch in K.bounded(batches):
        shards, texts = [], []
        for raw, held in zip(K.texts(batch.column("text")), batch.column("owned")):
            words = raw.split()
            g, _, _ = anchors(K.word_hashes(words), window, phrase)
            values, first = np.unique(g, return_index=True)
            for item in held.as_py():
                i = int(np.searchsorted(values, np.uint64(item["anchor"] % 2**64)))
                if i < len(values) and values[i] == np.uint64(item["anchor"] % 2**64):
                    shards.append(item["shard"])
                    texts.append(b" ".join(words[first[i] : first[i] + phrase]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(texts, pa.string())], ["shard", "phrase"])


def automaton(phrases: list[str]):
    """A blank on both sides of each phrase keeps words whole."""
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        made.add_word(f" {p} ")
    made.make_automaton()
    return made


def locate(machine, words: list[bytes], phrase: int) -> np.ndarray:
    """Places of the words at which the automaton's phrases begin."""
    text = b" ".join(words).decode()
    # place of the blank behind each word, in code points
    begin = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(words)) + 1)
    ends = np.fromiter((end for end, _ in machine.iter(f" {text} ")), np.int64)
    return np.searchsorted(begin, ends) - phrase + 1


def candidates(words: list[bytes], located: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, bytes]:
    """Places of the windows whose anchor begins at a located place, and their fingerprints in a row."""
    g, least, _ = anchors(K.word_hashes(words), window, phrase)
    hit = np.zeros(len(g), bool)
    hit[located] = True
    near = K.sliding(np.where(hit, g, K.TOP), window - phrase + 1)
    at = np.flatnonzero((near == least) & (near != K.TOP))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    raw = memoryview(b" ".join(words))
    spans = zip((ends - sizes)[at].tolist(), ends[at + window - 1].tolist())
    return at, b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in spans])


def _candidates(batches, window: int, phrase: int):
    """Rows in order of shard and part, in each of which phrases come before documents."""
    at, phrases, machine = None, [], None
    for batch in K.bounded(batches):
        docs, tags, places, prints = [], [], [], []
        texts = K.texts(batch.column("text"))
        for key, doc, tag, entry, raw in zip(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()), batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("entry").to_pylist(), texts):
            if key != at:
                at, phrases, machine = key, [], None
            if entry is not None:
                phrases.append(entry)
                continue
            if machine is None:
                machine = automaton(phrases)
            words = raw.split()
            found, fps = candidates(words, locate(machine, words, phrase), window, phrase)
            docs.append(np.full(len(found), doc))
            tags.append(np.full(len(found), tag))
            places.append(found)
            prints.append(fps)
        if docs:
            fps = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
            whole = [np.concatenate(docs), np.concatenate(tags), np.concatenate(places), fps[:, 0], fps[:, 1]]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            for i in range(0, len(fps), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + 100_000]), t) for c, t in zip(whole, types)], ["doc", "tag", "at", "fp1", "fp2"])


def _cut(batches, window: int, with_text: bool):
    names = ["doc", "tag", "cut", "kept_sha", *["kept_text"] * with_text]
    for batch in K.bounded(batches):
        n, sha, text = [], [], []
        for raw, marked in zip(K.texts(batch.column("text")), batch.column("marked")):
            words = raw.split()
            gone = K.cover(np.asarray(marked.values, np.int64), window, len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            n.append(int(gone.sum()))
            sha.append(hashlib.sha256(kept).digest())
            if with_text:
                text.append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), *[pa.array(text, pa.string())] * with_text], names
        )


def repeated(spark: SparkSession, docs: DataFrame, window: int = 50, phrase: int = 8, with_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (null where nothing goes)."""
    ship(spark)
    scratch = Scratch(spark, "substring")
    docs = own(docs, "doc_id", "text")
    # a null doc_id comes after the greatest one: that is moved out of its way
    last = (1 << 63) - 1
    doc = F.when(F.col("doc_id") == last, F.lit(last - 1)).otherwise(F.coalesce("doc_id", F.lit(last)))
    sig = scratch.table(
        docs.mapInArrow(partial(_signatures, window=window, phrase=phrase), "doc_id long, n_words long, sha binary, anchors array<long>").withColumn("doc", doc),
        "signatures",
    )
    # Documents of one doc_id are told apart by their words, by a tag; where there are none, the tag is 0 and costs nothing.
    several = sig.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    tag = lambda sha: F.xxhash64(sha) if several else F.lit(0).cast("long")
    # Classes of two documents or more, written: most documents have none, and a hot class can be split in the joins.
    classes = sig.where(F.col("n_words") >= window).groupBy(F.col("sha").alias("c_sha")).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(classes.where("n > 1").drop("n"), "classes")
    classed = sig.join(classes, F.col("sha") == F.col("c_sha"), "left")
    reps = classed.where(F.col("rep").isNull() | (F.col("doc") == F.col("rep")))
    each = reps.select("doc", F.explode("anchors").alias("anchor")).distinct()
    common = each.groupBy(F.col("anchor").alias("c_anchor")).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("c_anchor", F.col("least").alias("owner"))
    common = scratch.table(common, "recurring")
    # Owners with very many phrases fill shards of their own; the others share them.
    shards = -(-common.count() // SHARD_PHRASES)
    sizes = common.groupBy(F.col("owner").alias("s_owner")).agg(F.count(F.lit(1)).alias("n"))
    slot = F.when(F.col("n") > SHARD_PHRASES, F.pmod(F.xxhash64("c_anchor"), F.ceil(F.col("n") / SHARD_PHRASES)) + 1).otherwise(F.lit(0))
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(1, shards))) + F.when(slot > 0, F.pmod(F.xxhash64("owner", slot), F.lit((1 << 40) - 1)) + shards).otherwise(F.lit(0))
    common = scratch.table(common.join(sizes, F.col("owner") == F.col("s_owner")).select("c_anchor", "owner", shard.alias("shard")), "shards")
    holders = each.join(common, F.col("anchor") == F.col("c_anchor")).groupBy(F.col("doc").alias("h_doc")).agg(
        F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("doc") == F.col("owner"), F.struct("anchor", "shard"))).alias("owned")
    )
    holders = scratch.table(holders, "holders")
    whole = docs.select(doc.alias("doc"), "text").where(F.col("text").isNotNull())
    held = scratch.table(whole.join(holders, F.col("doc") == F.col("h_doc")).drop("h_doc").withColumn("tag", tag(_joined("text"))), "held")
    phrases = held.where(F.size("owned") > 0).select("text", "owned").mapInArrow(partial(_phrases, window=window, phrase=phrase), "shard long, phrase string")
    phrases = scratch.table(phrases.distinct(), "phrases")
    routed = held.select("doc", "tag", "text", F.explode("shards").alias("shard"))
    loads = routed.groupBy(F.col("shard").alias("l_shard")).agg(F.ceil(F.sum(F.octet_length("text")) / PART_BYTES).cast("int").alias("parts"))
    loads = scratch.table(loads, "loads")
    entry = phrases.join(loads, F.col("shard") == F.col("l_shard")).select(
        F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("tag"), F.lit(None).cast("string").alias("text"), "shard",
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)).alias("part"), F.col("phrase").alias("entry"),
    )
    routed = routed.join(loads, F.col("shard") == F.col("l_shard")).select(
        "doc", "tag", "text", "shard", F.pmod(F.xxhash64("doc", "tag"), F.greatest(F.col("parts"), F.lit(1))).cast("int").alias("part"), F.lit(None).cast("string").alias("entry")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.table(
        entry.unionByName(routed).repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", F.col("entry").isNull())
        .mapInArrow(partial(_candidates, window=window, phrase=phrase), "doc long, tag long, at int, fp1 long, fp2 long"),
        "windows",
    )
    owners = (
        found.groupBy("fp1", "fp2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last")
        .select(F.col("fp1").alias("o1"), F.col("fp2").alias("o2"), "owner")
    )
    # On complements nothing is partitioned yet: the join gets exchanges of its own, in which a hot window can be split.
    same = (F.bitwise_not("fp1") == F.bitwise_not("o1")) & (F.bitwise_not("fp2") == F.bitwise_not("o2"))
    marked = (
        found.join(owners, same & (F.col("doc") > F.col("owner")))
        .groupBy(F.col("doc").alias("m_doc"), F.col("tag").alias("m_tag")).agg(F.collect_set("at").alias("marked"))
    )
    schema = "doc long, tag long, cut long, kept_sha binary" + ", kept_text string" * with_text
    cut = scratch.table(
        held.select("doc", "tag", "text").join(marked, (F.col("doc") == F.col("m_doc")) & (F.col("tag") == F.col("m_tag"))).select("doc", "tag", "text", "marked")
        .mapInArrow(partial(_cut, window=window, with_text=with_text), schema),
        "cut",
    )
    text = ["kept_text"] * with_text
    cut = cut.dropDuplicates(["doc", "tag"]).select(F.col("doc").alias("c_doc"), F.col("tag").alias("c_tag"), "cut", "kept_sha", *text)
    joined = classed.withColumn("tag", tag(F.lower(F.hex("sha")))).join(cut, (F.col("doc") == F.col("c_doc")) & (F.col("tag") == F.col("c_tag")), "left")
    copy = F.col("doc") > F.col("rep")  # all of its windows start in the class's least document
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    columns = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return joined.select(*columns)


def _joined(text: str):
    """The SHA-256, in hexadecimal digits, of the words of a text joined by one blank each."""
    return F.sha2(F.trim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")), 256)
