"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half the hashes of a document's word shingles. Two
fingerprints link at ``radius`` or fewer differing bits. Fingerprints meet in buckets of equal
bands of bits (of any size, see blocks.deal). In a bucket the fingerprints lie as bit planes: word w
of plane p has bit p of 64 fingerprints. One fingerprint is compared with 64 at once: eight planes'
differences at a time go through carry-save adders into a counter of as many bits as the radius has
and an overflow bit, and words whose 64 distances all exceed the radius are abandoned. Buckets give
edges that connect what they link, and alternating stars join them to components.

Fingerprints of 64 bits (near_dedup) have bands such that linked ones always agree in some of them,
see plan: no link is lost. So short a fingerprint can't tell a similarity of 0.8, where pairs
differ in 10 bits on average and unrelated ones in 32; a radius of 4 finds 3 % of them. For that
there are wide ones (near_dedup with ``similarity``): WIDE bits, of which PROBE make the bands and a
first comparison, so that exchanges stay small; what that connects is compared in all bits. A pair's
bits differ independently with a chance of acos(c) / pi, c = 2 J / (1 + J) at a Jaccard similarity of
J. The radius is put where 94 of 100 pairs at J = similarity are linked, 99 of 100 at J + 0.05, 1 of
6 at J - 0.1 and 1 of 300 at J - 0.2; bands and first comparison miss 1 of 60 at J. Nothing
depends on the size of the input but the number of bands, which keeps the buckets small. What the
bits link is then verified by the shingles themselves: the documents that got so far are read once
more, their shingles' 64-bit hashes go with the fingerprints, and a pair links only at a Jaccard
similarity of ``similarity`` or more. Pairs that others have connected already are not looked at.

Defined results: a null text or one without words has fingerprint 0, which is linked like any
other. Texts of fewer words than a shingle are one shingle. component_id is the least doc_id
reachable; it is null only if all of those are null. Rows that repeat each other, and other
documents of equal fingerprints, are one node and give one row each; of rows that tie, one is kept.
Long texts are hashed in blocks of shingles. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import blocks
from corpuloom.llm import kernels as K
from corpuloom.llm.common import kept_schema, own
from corpuloom.llm.components import components
from corpuloom.session import Scratch, ship

SEED = 42
BLOCK = 4096
WIDE, PROBE = 512, 128
#: Fingerprints that a bucket of the wide ones is expected to have at most.
BUCKET = 256
_STEP = 8  # planes between looks at what to abandon
_BATCH = 16384  # shingles at a time


def _counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    full = len(h) // 255 * 255
    total = bits[full:].sum(0, dtype=np.int64)
    if full:  # 255 rows fit a byte
        total += bits[:full].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, shingle: int, bits: int = 64) -> bytes:
    """Little-endian words. The first 64 bits vote by XXH64 itself, each further 64 by a mix of it."""
    words = (text or b"").lower().split()  # bytes: A-Z only
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(bits, np.int64)
    for at in range(0, n, _BATCH):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BATCH], ends[at : at + _BATCH])], np.uint64)
        counts += _counts(np.stack([h, *[K.mix(h + K.U64(i * K._ODD[0] % 2**64)) for i in range(1, bits // 64)]], axis=1))
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def _prints(batches, shingle: int, bits: int, keep: tuple[str, ...]):
    for batch in K.bounded(batches):
        found = [fingerprint(t, shingle, bits) for t in K.texts(batch.column("text"))]
        if bits == 64:
            fps = pa.array(np.frombuffer(b"".join(found), "<i8"))
        else:
            fps = pa.array(found, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), fps, *[batch.column(k) for k in keep]], ["doc_id", "fp", *keep])


def _add(a, b, c):
    """Carry-save: sum and carry of three words of bits."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _add_eight(counter: list[np.ndarray], over: np.ndarray, d: list[np.ndarray]) -> np.ndarray:
    """Adds eight words of bits to the vertical counter; returns its overflow."""
    s1, c1 = _add(d[0], d[1], d[2])
    s2, c2 = _add(d[3], d[4], d[5])
    s3, c3 = _add(s1, s2, d[6])
    ones, c4 = s3 ^ d[7], s3 & d[7]
    t1, f1 = _add(c1, c2, c3)
    twos, f2 = t1 ^ c4, t1 & c4
    carry = None
    for i, part in enumerate((ones, twos, f1 ^ f2, f1 & f2)):
        if i >= len(counter):
            over = over | part
        elif carry is None:
            counter[i], carry = counter[i] ^ part, counter[i] & part
        else:
            counter[i], carry = _add(counter[i], part, carry)
    for i in range(4, len(counter)):
        counter[i], carry = counter[i] ^ carry, counter[i] & carry
    return over | carry


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    equal, more = ~np.zeros_like(counter[0]), np.zeros_like(counter[0])
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            more, equal = more | (equal & counter[i]), equal & ~counter[i]
    return more


def near(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of fingerprints within the radius, of all buckets fps[start:end] at once.

    fps has a row of 64-bit words (or one word) per fingerprint.
    """
    fps = fps.reshape(len(fps), -1)
    sizes = ends - starts
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - np.repeat(starts, sizes)
    word = first_word[bucket] + lane // 64
    bit = (lane % 64).astype(np.uint64)
    n_planes = 64 * fps.shape[1]
    planes = np.zeros((n_planes, int(first_word[-1])), np.uint64)  # vertical: planes[p][w] has bit p of 64 fingerprints
    valid = np.zeros(int(first_word[-1]), np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << bit)
    order = np.arange(len(fps))
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    for p in range(n_planes):
        planes[p][word[cuts]] = np.bitwise_or.reduceat(((fps[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << bit, cuts) if len(fps) else 0
    out_a, out_b = [], []
    # lanes of work: (fingerprint, word of its bucket)
    per = words[bucket]
    for lo, hi in _slices(per, 1 << 17):
        query = np.repeat(order[lo:hi], per[lo:hi])
        offset = np.arange(len(query)) - np.repeat(np.cumsum(per[lo:hi]) - per[lo:hi], per[lo:hi])
        target = first_word[bucket[query]] + offset
        live = (offset + 1) * 64 > lane[query]  # a pair is looked at from its first member
        query, target = query[live], target[live]
        over = np.zeros(len(query), np.uint64)
        counter = [over] * max(1, radius.bit_length())
        for p in range(0, n_planes, _STEP):
            q = fps[query, p // 64]
            d = [planes[i][target] ^ (np.uint64(0) - ((q >> np.uint64(i % 64)) & np.uint64(1))) for i in range(p, p + _STEP)]
            over = _add_eight(counter, over, d)
            stay = (~(over | _beyond(counter, radius)) & valid[target]) != 0
            if not stay.all():
                query, target, over = query[stay], target[stay], over[stay]
                counter = [c[stay] for c in counter]
            if not len(query):
                break
        if len(query):
            alive = ~(over | _beyond(counter, radius)) & valid[target]
            bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            a = query[w]
            other = starts[bucket[a]] + (target[w] - first_word[bucket[a]]) * 64 + b
            fresh = other > a
            out_a.append(a[fresh])
            out_b.append(other[fresh])
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a) if out_a else none), (np.concatenate(out_b) if out_b else none)


def _slices(per: np.ndarray, most: int):
    """Ranges of fingerprints with about ``most`` lanes of work each."""
    total = np.cumsum(per)
    lo = 0
    while lo < len(per):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, "right")))
        yield lo, hi
        lo = hi


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 of the shingles that fingerprint() takes."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    width = min(shingle, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[at[i] : at[i + width] - 1], SEED) for i in range(len(words) - width + 1)), "<u8"))


def _hashed(batches, shingle: int):
    for batch in K.bounded(batches):
        sets = [shingle_hashes(t, shingle).tobytes() for t in K.texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def verified(a: np.ndarray, b: np.ndarray, sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Of the pairs of places, some that connect as much as all those do whose sets are that similar."""
    root: dict[int, int] = {}
    known: dict[int, frozenset] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def of(x: int) -> frozenset:
        if x not in known:
            known[x] = frozenset(np.frombuffer(sets[x], "<u8").tolist())
        return known[x]

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        least, most = sorted((len(sets[x]), len(sets[y])))
        if p == q or least < similarity * most - 1e-6:
            continue
        m, n = of(x), of(y)
        both = len(m & n)
        if both / (len(m) + len(n) - both) >= similarity:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _links(batches, key: list[str], member: str, fp: tuple[str, ...], radius: int, similarity: float | None = None):
    """Edges between members; their fingerprints are in 64-bit columns or in one binary column. With ``similarity`` they are verified by their shingles."""

    def work(table: pa.Table):
        starts, ends = blocks.runs(table, key)
        if pa.types.is_binary(table.schema.field(fp[0]).type):
            fps = np.frombuffer(b"".join(table.column(fp[0]).to_pylist()), "<u8").reshape(table.num_rows, -1)
        else:
            fps = np.stack([table.column(c).to_numpy().view(np.uint64) for c in fp], axis=1)
        ids = table.column(member).to_numpy()
        pairs = near(fps, starts, ends, radius)
        kept = blocks.forest(*pairs) if similarity is None else verified(*pairs, table.column("shingles").to_pylist(), similarity)
        if kept:
            x, y = np.array(kept).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    yield from blocks.streamed(batches, key, work)


def _edges(spark: SparkSession, members: DataFrame, key: list[str], member: str, fp: tuple[str, ...], radius: int, block: int, similarity: float | None = None) -> DataFrame:
    dealt = blocks.deal(members, key, member, block)
    key = [*key, "_i", "_j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, *key).sortWithinPartitions(*key, member)
        .mapInArrow(partial(_links, key=key, member=member, fp=fp, radius=radius, similarity=similarity), "a long, b long")
    )


def plan(count: int, radius: int) -> list[int]:
    """Masks of the bits on which 64-bit fingerprints meet, as signed integers.

    With radius + r bands, linked fingerprints agree in r bands at least, so all choices of r
    bands find every link. r is the least for which a bucket is expected to fit one machine word
    of 64 fingerprints; more of them mean wider masks and so smaller buckets, never missed links.
    """
    for r in range(1, 6):
        bands = radius + r
        if count <= 64 * 2 ** (64 * r / bands) or r == 5:
            break
    at = [64 * i // bands for i in range(bands + 1)]
    masks = [sum((1 << at[i + 1]) - (1 << at[i]) for i in chosen) for chosen in combinations(range(bands), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link(spark: SparkSession, prints: DataFrame, scratch: Scratch, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """64-bit fingerprints (fp) -> fp, root over the links; fingerprints without one don't occur."""
    fps = scratch.table(prints.select("fp").distinct(), "fingerprints")
    masks = plan(fps.count(), radius)
    banded = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "bits"))
    edges = _edges(spark, banded, ["band", "bits"], "fp", ("fp",), radius, block)
    return components(scratch, edges).select(F.col("node").alias("fp"), "root")


def differing(similarity: float) -> float:
    """The chance that a bit differs between documents of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_plan(count: int, similarity: float) -> tuple[list[list[int]], int, int]:
    """Bits of each band, the radius of the first comparison and that of all bits."""
    p = differing(similarity)
    size = min(40, max(8, math.ceil(math.log2(max(count, 1) / BUCKET))))
    bands = math.ceil(math.log(0.01) / math.log1p(-((1 - p) ** size)))
    rng = np.random.default_rng((17, size))
    chosen = [sorted(rng.choice(PROBE, size, replace=False).tolist()) for _ in range(bands)]
    reach = lambda bits, deviations: round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))
    return chosen, reach(PROBE, 2.6), reach(WIDE, 1.55)


def link_wide(spark: SparkSession, prints: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float, shingle: int, block: int = BLOCK) -> DataFrame:
    """Fingerprints of WIDE bits (binary fp) -> fp, root over the links; fingerprints without one don't occur.

    prints also has _text, the key under which ``texts`` (_key, text) has the text.
    """
    words = PROBE // 64
    fps = scratch.table(prints.select("fp").distinct().withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    bands, first, radius = wide_plan(fps.count(), similarity)
    probes = fps.mapInArrow(_probes, "id long, " + ", ".join(f"p{i} long" for i in range(words)))

    def masked(bits: list[int]) -> list[Column]:
        masks = [sum(1 << b % 64 for b in bits if b // 64 == i) for i in range(words)]
        return [F.col(f"p{i}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for i, m in enumerate(masks)]

    names = tuple(f"p{i}" for i in range(words))
    # a bucket is named by a hash of its band and bits: should two share a name, their members are compared in vain
    meets = F.explode(F.array(*[F.xxhash64(F.lit(i), *masked(bits)) for i, bits in enumerate(bands)])).alias("bucket")
    near_by = components(scratch, _edges(spark, probes.select("id", *names, meets), ["bucket"], "id", names, first, block), "probe")
    groups = scratch.table(fps.join(near_by.select(F.col("node").alias("id"), F.col("root").alias("group")), "id"), "groups")
    # one text of each fingerprint that has met another
    chosen = scratch.table(groups.select("id", "fp").join(prints.groupBy("fp").agg(F.min("_text").alias("_text")), "fp").select("id", "_text"), "chosen")
    sets = texts.join(chosen, F.col("_key") == F.col("_text")).select("id", "text").mapInArrow(partial(_hashed, shingle=shingle), "id long, shingles binary")
    sets = scratch.table(sets.groupBy(F.col("id").alias("s_id")).agg(F.min("shingles").alias("shingles")), "shingles")
    members = groups.join(sets, F.col("id") == F.col("s_id")).select("id", "fp", "group", "shingles")
    # members now carry their shingles, so fewer of them make a block
    roots = components(scratch, _edges(spark, members, ["group"], "id", ("fp",), radius, max(1, block // 4), similarity), "wide")
    return groups.select("fp", "id").join(roots, F.col("id") == F.col("node")).select("fp", "root")


def _probes(batches):
    for batch in batches:
        bits = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<i8").reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PROBE // 64)]], ["id", *[f"p{i}" for i in range(PROBE // 64)]])


def near_dedup(
    spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = BLOCK, keep: tuple[str, ...] = (), similarity: float | None = None
) -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (hexadecimal digits), component_id, kept (one row of a component) and the columns named in keep.

    With ``similarity`` given, fingerprints are wide and what they find links at that Jaccard similarity
    of shingle sets or more; ``radius`` is not used then.
    """
    if not 0 <= radius <= 63:
        raise ValueError("radius must be 0 to 63")
    ship(spark)
    scratch = Scratch(spark, "simhash")
    bits, kind = (64, "long") if similarity is None else (WIDE, "binary")
    placed = own(docs, "doc_id", "text", *keep).withColumn("_text", F.xxhash64("text"))
    prints = scratch.table(
        placed.mapInArrow(partial(_prints, shingle=shingle, bits=bits, keep=(*keep, "_text")), f"doc_id long, fp {kind}" + kept_schema(placed, (*keep, "_text")))
        .withColumn("_row", F.monotonically_increasing_id()),
        "prints",
    )
    roots = link(spark, prints, scratch, radius, block) if similarity is None else link_wide(spark, prints, placed.select(F.col("_text").alias("_key"), "text"), scratch, similarity, shingle, block)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    classes = scratch.table(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    # Only linked fingerprints have another's first row; both sides of each join are written, so a hot root or fingerprint can be split.
    rooted = scratch.table(classes.join(roots, "fp"), "rooted")
    firsts = scratch.table(rooted.groupBy(F.col("root").alias("f_root")).agg(F.min("first").alias("least")), "firsts")
    linked = scratch.table(rooted.join(firsts, F.col("root") == F.col("f_root")).select(F.col("fp").alias("l_fp"), "least"), "linked")
    named = scratch.table(
        classes.join(linked, F.col("fp") == F.col("l_fp"), "left").select(F.col("fp").alias("n_fp"), F.coalesce("least", "first").alias("first")), "named"
    )
    return prints.join(named, F.col("fp") == F.col("n_fp")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), bits // 4, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        (F.col("first.row") == F.col("_row")).alias("kept"),
        *keep,
    )
