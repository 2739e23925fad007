"""Embedding near-dedup with spherical-cap filters.

A direction is a product of codes: the dimensions are cut into blocks, each block has a small
random codebook of unit vectors, and each choice of one code per block is a filter. A vector is
list-decoded to all filters whose inner product with it exceeds its threshold, which is set such
that a stated number of filters do: with one threshold for all vectors, products of small codebooks
leave some without any filter (recall at a cosine of 0.95 was 0.5). Vectors are decoded after each of
several seeded random rotations, whose filters are told apart. A rotated pair lies like a random pair
of its cosine, so what a rotation misses does not depend on how energy is spread over the dimensions,
and rotations miss independently.

1. Vectors of the same numbers are one class with a count.
2. Classes join on filters. Only a sketch goes there, the signs of SKETCH random projections: a
   bit differs with a chance of acos(cosine) / pi, so of the pairs at the least cosine one of a
   million differs in more bits than the radius allows, and unrelated ones never come near it.
   A bucket gives edges that connect what its sketches connect.
3. What these edges connect is a group, which holds all links of its members. Each vector goes
   to its group once and meets all others of it there, in double precision. A large group is cut into
   blocks that meet in pairs; where meeting by filters is cheaper, it goes by (group, filter)
   instead, and a pair that shares several filters counts in the least of them. Links are counted
   inside the tasks, and only counts and connecting edges leave them.

The number of codes grows with that of the vectors, so that a filter has some BUCKET vectors, and
the filters per vector and rotation grow with the codes (see effort). Of pairs at a cosine of 0.95 at
least 0.996 share a filter at each number of codes from 4 to 300, for 8e9 filters and as
many vectors times a hundred; tests measure that, and the whole against brute force, on sparse
vectors and uneven dimensions too.

Defined results: a vector that is null, empty, zero or has null or non-finite components links with
nothing; vectors of different lengths neither. component_id is the least vec_id reachable, its own
included (null if all are null). Rows that repeat each other are vectors of their own. Very long
vectors are rows like others. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import blocks
from corpuloom.llm.common import own
from corpuloom.llm.components import components
from corpuloom.session import Scratch, ship, spread

BLOCKS, BUCKET, BLOCK, SKETCH = 4, 1000, 512, 128
#: Sketches are compared in blocks of so many.
SKETCHES = 4096


def effort(codes: int) -> tuple[int, int]:
    """Rotations, and filters per vector and rotation."""
    if codes <= 6:
        return 2, 8
    return 3, 8 if codes <= 16 else 12 if codes <= 40 else 16 if codes <= 64 else 24 if codes <= 160 else 32


def size_for(count: int) -> int:
    """The least number of codes a block at which a filter has at most BUCKET of so many vectors."""
    codes = 4
    while count * effort(codes)[1] > BUCKET * codes**BLOCKS:
        codes += 1
    return codes


def codebooks(dim: int, codes: int, seed: int = 7) -> list[tuple[int, int, np.ndarray]]:
    """For each block of dimensions its range and its unit codes; a block of one dimension has but two."""
    count = min(BLOCKS, dim)
    edges = [dim * i // count for i in range(count + 1)]
    made = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if hi - lo == 1:
            made.append((lo, hi, np.array([[1.0], [-1.0]])))
            continue
        x = np.random.default_rng((seed, dim, i)).standard_normal((codes, hi - lo))
        made.append((lo, hi, x / np.linalg.norm(x, axis=1)[:, None]))
    return made


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def rotations(dim: int, count: int, seed: int = 11) -> list[np.ndarray]:
    """Random orthogonal matrices."""
    made = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng((seed, dim, i)).standard_normal((dim, dim)))
        made.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return made


def decode(x: np.ndarray, books: list[tuple[int, int, np.ndarray]], expect: int) -> np.ndarray:
    """For each unit vector (a row) the sorted filters that exceed its threshold, the one that ``expect`` of them exceed.

    Blocks are joined one by one. With both sides in falling order, the sum of the i-th and the
    j-th is among the best ``expect`` only if i * j <= expect, so few sums are looked at.
    """
    scores = ids = np.zeros((len(x), 1))
    for lo, hi, c in books:
        own_scores, own_ids = _best(x[:, lo:hi] @ c.T, np.broadcast_to(np.arange(len(c)), (len(x), len(c))), expect)
        i, j = np.indices((scores.shape[1], own_scores.shape[1])).reshape(2, -1)
        few = (i + 1) * (j + 1) <= expect
        i, j = i[few], j[few]
        scores, ids = _best(scores[:, i] + own_scores[:, j], ids[:, i] * len(c) + own_ids[:, j], expect)
    return np.sort(ids.astype(np.int64), axis=1)


def filters(x: np.ndarray, codes: int, books: dict | None = None) -> np.ndarray:
    """For each unit vector (a row) the sorted filters of all rotations; ``books`` keeps what a number of dimensions needs."""
    dim, books = x.shape[1], {} if books is None else books
    turns, expect = effort(codes)
    if dim not in books:
        books[dim] = codebooks(dim, codes), rotations(dim, turns)
    own_books, turned = books[dim]
    return np.hstack([decode(x @ r, own_books, expect) + i * codes**BLOCKS for i, r in enumerate(turned)])


def sketches(x: np.ndarray) -> np.ndarray:
    """SKETCH signs of random projections of each row, as 64-bit words."""
    planes = np.random.default_rng((23, x.shape[1])).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ planes > 0, axis=1, bitorder="little").view("<u8")


def reach(least: float) -> int:
    """Differing bits that all but a millionth of the pairs at the least cosine stay within."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    tail, k = 1.0, -1
    while tail > 1e-6:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def units(vectors: list, dim: int) -> np.ndarray:
    x = np.asarray(vectors, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


_HASHED = "row long, dim int, h1 long, h2 long, s1 long, s2 long, filters array<long>"


def _hashed(batches, codes: int):
    books: dict[int, tuple] = {}
    names = [c.split()[0] for c in _HASHED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            vectors = [np.asarray(v, np.float64) + 0.0 for v in part.column("vector").to_pylist()]  # -0.0 becomes 0.0
            lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(vectors)
            signs = np.zeros((len(vectors), SKETCH // 64), np.uint64)
            for dim in {len(v) for v in vectors}:
                places = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = units([vectors[i] for i in places], dim)
                signs[places] = sketches(x)
                for i, found in zip(places, filters(x, codes, books)):
                    lists[i] = found
            digests = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors), "<i8").reshape(-1, 2)
            longs = [pa.array(np.ascontiguousarray(c)) for c in (digests[:, 0], digests[:, 1], signs[:, 0].view(np.int64), signs[:, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([len(v) for v in vectors], pa.int32()), *longs, pa.array(lists, pa.list_(pa.int64()))], names
            )


def _meet(batches, key: list[str], radius: int):
    """Edges that connect what the sketches of a bucket connect."""

    def work(table: pa.Table):
        starts, ends = blocks.runs(table, key)
        ids, side = table.column("class").to_numpy(), table.column("_side").to_numpy()
        same = table.column("_i").to_numpy() == table.column("_j").to_numpy()
        bits = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
        x_all, y_all = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            for at in range(s, e, 256):
                low = bits[at : min(at + 256, e)]
                away = np.zeros((len(low), e - s), np.uint8)
                for w in range(bits.shape[1]):
                    away += np.bitwise_count(low[:, w, None] ^ bits[None, s:e, w])
                x, y = np.nonzero(away <= radius)
                x, y = x + at, y + s
                fresh = x < y if same[s] else side[x] < side[y]
                x_all.append(x[fresh])
                y_all.append(y[fresh])
        kept = blocks.forest(np.concatenate(x_all), np.concatenate(y_all)) if x_all else []
        if kept:
            x, y = np.array(kept).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    yield from blocks.streamed(batches, key, work)


def _shared(lists: list[np.ndarray], n: int) -> np.ndarray | None:
    """How many entries each two lists have in common; None if no entry is in two lists."""
    owner = np.repeat(np.arange(n), [len(m) for m in lists])
    values, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    if not len(often):
        return None
    rank = np.full(len(values), -1)
    rank[often] = np.arange(len(often))
    place = rank[place]
    total = np.zeros((n, n), np.float32)
    for at in range(0, len(often), 4096):  # in columns, so that memory stays bounded
        here = (place >= at) & (place < at + 4096)
        seen = np.zeros((n, min(4096, len(often) - at)), np.float32)
        seen[owner[here], place[here] - at] = 1
        total += seen @ seen.T
    return total


def _verify(batches, key: list[str], least: float):
    def work(table: pa.Table):
        starts, ends = blocks.runs(table, key)
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        side = table.column("_side").to_numpy()
        same = table.column("_i").to_numpy() == table.column("_j").to_numpy()
        at_filter = table.column("filter").to_numpy()
        dims = table.column("dim").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.concatenate([[0], np.cumsum(dims)])
        lists = table.column("filters").combine_chunks()
        links = np.zeros(table.num_rows, np.int64)
        a_all, b_all = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            x = flat[first[s] : first[e]].reshape(e - s, -1)
            x = x / np.abs(x).max(1)[:, None]
            x = x / np.linalg.norm(x, axis=1)[:, None]
            p, q = np.nonzero(np.triu(x @ x.T >= least, 1)) if same[s] else np.nonzero((x @ x.T >= least) & (side[s:e, None] < side[None, s:e]))
            if not len(p):
                continue
            if at_filter[s] >= 0:  # of the filters that both lie in, the pair counts in the least
                members = [np.asarray(lists[s + i].values) for i in range(e - s)]
                upto = [m[: np.searchsorted(m, at_filter[s])] for m in members]
                shared = _shared(upto, e - s)
                if shared is not None:
                    fresh = shared[p, q] == 0
                    p, q = p[fresh], q[fresh]
            np.add.at(links, s + p, copies[s + q])
            np.add.at(links, s + q, copies[s + p])
            a_all.append(s + p)
            b_all.append(s + q)
        hit = np.flatnonzero(links)
        kept = blocks.forest(np.concatenate(a_all), np.concatenate(b_all)) if a_all else []
        x, y = np.array(kept, np.int64).reshape(-1, 2).T
        # a count has b null, an edge has n null
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[hit], ids[x]]), pa.int64()),
                pa.array([None] * len(hit) + ids[y].tolist(), pa.int64()),
                pa.array(links[hit].tolist() + [None] * len(x), pa.int64()),
            ],
            ["a", "b", "n"],
        )

    yield from blocks.streamed(batches, key, work)


def near_dedup(spark: SparkSession, vectors: DataFrame, least: float = 0.95, block: int = BLOCK, codes: int | None = None) -> DataFrame:
    """A row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    ship(spark)
    scratch = Scratch(spark, "vectors")
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    v = F.col("embedding").cast(kind)
    usable = (
        F.coalesce(F.size(v) > 0, F.lit(False))
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    rows = scratch.table(
        own(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.when(usable, v).alias("vector"), F.monotonically_increasing_id().alias("row")), "rows"
    )
    whole = rows.where(F.col("vector").isNotNull()).select("row", "vector")
    codes = codes or size_for(whole.count())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = scratch.table(spread(whole).mapInArrow(partial(_hashed, codes=codes), _HASHED), "hashed")
    # a class of identical vectors (equal 128-bit digests and dimensions) is named by its least row
    classes = scratch.table(
        hashed.groupBy("dim", "h1", "h2")
        .agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("filters").alias("filters")),
        "classes",
    )
    key = ["dim", "filter", "_i", "_j"]
    members = classes.select("class", "dim", "s1", "s2", F.explode("filters").alias("filter"))
    dealt = blocks.deal(members, ["dim", "filter"], "class", SKETCHES)
    meets = dealt.repartition(parts, *key).sortWithinPartitions(*key, "class").mapInArrow(partial(_meet, key=key, radius=reach(least)), "a long, b long")
    groups = components(scratch, meets, "groups").select(F.col("node").alias("g_class"), F.col("root").alias("group"))
    grouped = scratch.table(classes.select("class", "copies", "dim", "filters").join(groups, F.col("class") == F.col("g_class")).drop("g_class"), "grouped")
    # A group meets as a whole or by filters, whichever moves fewer rows.
    moved = lambda n: n * F.ceil(n / block)
    large = grouped.groupBy(F.col("group").alias("l_group")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = scratch.table(large, "large")
    split = (
        grouped.select("group", F.explode("filters").alias("filter")).join(large, F.col("group") == F.col("l_group"))
        .groupBy("group", "filter").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        .groupBy("group").agg(F.sum(moved(F.col("m"))).alias("cost"), F.first("n").alias("n"))
        .where(F.col("cost") < moved(F.col("n"))).select(F.col("group").alias("s_group"))
    )
    split = scratch.table(split, "split")
    by = F.when(F.col("s_group").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.col("filters"))
    met = grouped.join(split, F.col("group") == F.col("s_group"), "left").select(
        "class", "copies", "dim", "group", F.explode(by).alias("filter"), F.when(F.col("s_group").isNotNull(), F.col("filters")).alias("filters")
    )
    key = ["group", "filter", "_i", "_j"]
    dealt = blocks.deal(met, ["group", "filter"], "class", block)
    dealt = dealt.join(whole, F.col("class") == F.col("row")).drop("row")
    found = scratch.table(
        dealt.repartition(parts, *key).sortWithinPartitions(*key, "class").mapInArrow(partial(_verify, key=key, least=least), "a long, b long, n long"), "found"
    )
    counts = scratch.table(found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("c_class")).agg(F.sum("n").alias("links")), "counts")
    roots = components(scratch, found.where(F.col("b").isNotNull()).select("a", "b"))
    named = classes.join(counts, F.col("class") == F.col("c_class"), "left").join(roots, F.col("class") == F.col("node"), "left")
    named = scratch.table(
        named.select("h1", "h2", "dim", "class", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named"
    )
    keys = hashed.select("row", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("dim").alias("k_dim"))
    of_row = keys.join(named, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & (F.col("k_dim") == F.col("dim"))).select(F.col("row").alias("n_row"), "root", "n_links")
    joined = scratch.table(
        rows.select("vec_id", "row").join(of_row, F.col("row") == F.col("n_row"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "row").alias("root")),
        "joined",
    )
    ids = scratch.table(joined.groupBy(F.col("root").alias("i_root")).agg(F.min("vec_id").alias("component_id")), "ids")
    return joined.join(ids, F.col("root") == F.col("i_root")).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
