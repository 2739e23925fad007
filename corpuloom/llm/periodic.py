"""Periodic runs of words, by the runs theorem.

A run is a stretch of consecutive words whose smallest period is q, of at least max(24, 3 q) words,
which no neighbouring word extends. Each run holds a root (one period of it) that is a Lyndon word,
the longest one that starts there, under an order of the words or under its reverse; so the longest
Lyndon words of all places under both orders are all the candidates there are. They come from the
inverse suffix array: the longest Lyndon word at a place ends before the next place of a smaller
rank, under the reverse order of a greater one. A candidate is extended to both sides by longest
common extensions, range minima of the LCP array (of the reversed words for the left side) from a
sparse table of which one level is held at a time. All of this takes memory linear in the words of
a batch, and a batch is 256 documents or less, or one long text.

The documents of a batch share one suffix array: ranks go by document first, and a mark that is less
than any word ends each document, so that nothing compares or extends across documents.

Optional loops(): words of a stated share of the documents repeat a stretch of theirs (a standing
disturbance that the registered query applies by its contract).

Defined results: a null text has no words, and no words make no run and four nulls. Among runs of
one exponent the first, then the shortest period is told. A null doc_id is never looped. Rows that
repeat each other give one row each. Texts of any length go through whole. Extra columns are
ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import ship

LEAST, TIMES = 24, 3
WORDS = 1 << 18  # of a batch, unless one text has more

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "n_words long, n_dropped long"
)


def ranks(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The inverse suffix array by prefix doubling of the places that are still tied. codes: 0 at the end of each document, else from 1."""
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    active = np.argsort(key, kind="stable")
    first, second = key[active], np.zeros(len(key), np.int64)
    base = np.zeros(len(key), np.int64)
    rank = np.empty(len(key), np.int64)
    width = 0
    while len(active):
        at = np.arange(len(active))
        new = np.empty(len(active), bool)
        new[:1] = True
        new[1:] = first[1:] != first[:-1]
        group = np.maximum.accumulate(np.where(new, at, 0))
        new[1:] |= second[1:] != second[:-1]
        head = np.maximum.accumulate(np.where(new, at, 0))
        # before the first round all places are one group from 0 on
        rank[active] = head if width == 0 else base + head - group
        tied = ~(new & np.append(new[1:], True))
        active = active[tied]
        width = max(1, 2 * width)
        base = rank[active]
        other = rank[active + width] if len(active) else base
        order = np.argsort(base * len(rank) + other, kind="stable")
        active, base, second = active[order], base[order], other[order]
        first = base
    return rank


def common(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes agree from a and from b on; the marks at the ends of documents stop it."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left) > 32:
        left = left[codes[a[left] + out[left]] == codes[b[left] + out[left]]]
        out[left] += 1
    for i in left.tolist():
        x, y, size = int(a[i] + out[i]), int(b[i] + out[i]), 64
        while True:
            part = min(size, len(codes) - max(x, y))
            differ = np.flatnonzero(codes[x : x + part] != codes[y : y + part])
            if len(differ):
                out[i] = x + int(differ[0]) - a[i]
                break
            x, y, size = x + part, y + part, size * 2
    return out


def marked(codes: np.ndarray) -> np.ndarray:
    """codes with each end mark told apart, so that no two suffixes agree beyond an end."""
    out = codes.copy()
    ends = np.flatnonzero(codes == 0)
    out[ends] = -1 - np.arange(len(ends))
    return out


def lcps(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each rank the codes that its suffix shares with the one before it.

    Only places whose suffix and its neighbour are preceded by different codes are compared; the sum of
    their values is at most n log n, and any other place has one less than the place before it.
    """
    n = len(codes)
    places = np.empty(n, np.int64)
    places[rank] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[places[1:]] = places[:-1]
    at = np.arange(n)
    inner = (at > 0) & (before > 0)
    apart = ~inner
    apart[inner] = codes[at[inner] - 1] != codes[before[inner] - 1]
    value = np.zeros(n, np.int64)
    compared = np.flatnonzero(apart & (before >= 0))
    value[compared] = common(codes, compared, before[compared])
    source = np.maximum.accumulate(np.where(apart, at, 0))
    return (value[source] - (at - source))[places]


def next_smaller(values: np.ndarray, rounds: int = 48) -> np.ndarray:
    """For each place the next one of a smaller value, len(values) where there is none.

    Places jump on along the answers found so far; the few that would take many jumps are left to a stack.
    """
    n = len(values)
    padded = np.append(values, values.min(initial=0) - 1)
    out = np.append(np.arange(1, n + 1), n)
    left = np.arange(n)
    for _ in range(rounds):
        left = left[padded[out[left]] > padded[left]]
        if not len(left):
            return out[:n]
        out[left] = out[out[left]]
    plain, found, stack = values.tolist(), [n] * n, []
    for i, v in enumerate(plain):
        while stack and plain[stack[-1]] > v:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, np.int64)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last], by a sparse table of which only the level in use is held."""
    out = np.empty(len(first), np.int64)
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    row = values
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(row[first[here]], row[last[here] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row
    return out


def extensions(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the suffixes at a and b (a < b) agree."""
    x, y = rank[a], rank[b]
    return range_minima(lcp, np.minimum(x, y) + 1, np.maximum(x, y))


def runs(words: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents, given as arrays of word numbers from 1 on: document, start, length, period, in that order."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes) - 1  # of the marks
    begins = ends - sizes + 1
    doc = np.repeat(np.arange(len(words)), sizes)
    codes = np.concatenate([np.append(w, 0) for w in words]) if len(words) else np.empty(0, np.int64)
    none = np.empty(0, np.int64)
    if len(codes) == len(words):
        return none, none, none, none
    rank, told = ranks(codes, doc), marked(codes)
    at = np.concatenate([np.arange(len(codes))] * 2)
    nxt = np.concatenate([next_smaller(rank), next_smaller(-rank)])
    end = ends[doc[at]]
    # a run's first root agrees with what follows for a period and more, or the stretch would be too short
    can = (at < end) & (nxt < end)
    at, nxt = at[can], nxt[can]
    same = codes[at] == codes[nxt]
    at, nxt = at[same], nxt[same]
    if not len(at):
        return none, none, none, none
    lcp = lcps(told, rank)
    right = extensions(rank, lcp, at, nxt)
    period = nxt - at
    far = right >= np.maximum((times - 2) * period + 1, least + 1 - 2 * period)
    at, period, right = at[far], period[far], right[far]
    if not len(at):
        return none, none, none, none
    # to the left: the same on reversed words, of the documents that still matter
    kept = np.unique(doc[at])
    place = np.searchsorted(kept, doc[at])
    r_ends = np.cumsum(sizes[kept]) - 1
    r_begins = r_ends - sizes[kept] + 1
    r_codes = np.concatenate([np.append(words[d][::-1], 0) for d in kept.tolist()])
    r_rank = ranks(r_codes, np.repeat(np.arange(len(kept)), sizes[kept]))
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > begins[doc[at]])
    # the word before place x of a document lies at (its end - x) of the reversed one
    x = r_begins[place[inner]] + ends[doc[at[inner]]] - at[inner]
    r_lcp = lcps(marked(r_codes), r_rank)
    y = x - period[inner]
    left[inner] = extensions(r_rank, r_lcp, y, x)
    start, length = at - left, left + period + right
    whole = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([doc[at[whole]], start[whole] - begins[doc[at[whole]]], period[whole], length[whole]]), axis=1)
    return found[0], found[1], found[3], found[2]


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a looped document, None for the other documents.

    With h the CRC-32 of the decimal doc_id and g = h // 10: where h % 10 is 0, the words from g % n on repeat their
    first 1 + (n - a) // (3 + g % 8).
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _batches(batches):
    """(doc_id, words) of documents, in lists of few documents and words."""
    held, size = [], 0
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), K.texts(batch.column("text"))):
            words = (raw or b"").split()
            if held and (size + len(words) > WORDS or len(held) == 256):
                yield held
                held, size = [], 0
            held.append((doc_id, words))
            size += len(words)
    if held:
        yield held


def _found(batches, loops: bool, least: int, times: int):
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in SCHEMA.split(", ")]
    for held in _batches(batches):
        numbers, texts = {}, []
        coded = []
        for doc_id, words in held:
            order = looped(len(words), doc_id) if loops else None
            if order is not None:
                words = [words[i] for i in order.tolist()]
            texts.append(words)
            coded.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words)))
        doc, start, length, period = runs(coded, least, times)
        cut = np.searchsorted(doc, np.arange(len(held) + 1)).tolist()
        rows = []
        for i, ((doc_id, _), words) in enumerate(zip(held, texts)):
            found = list(zip(*(x[cut[i] : cut[i + 1]].tolist() for x in (start, length, period))))
            kept, best, milli = words, (None, None, None), None
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, n, q in found:
                    gone[s + q] += 1
                    gone[s + n] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                milli = 1000 * best[1] // best[2]
            told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
            rows.append((doc_id, len(found), *best, milli, told, hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def detect(spark: SparkSession, docs: DataFrame, loops: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """A row per row of docs (doc_id, text): its runs of at least max(least, times * period) words and what stays of it.

    n_runs; start, length, period and exponent_milli of the run of the greatest exponent; runs_sha256 over
    ``start,length,period`` lines; collapsed_sha256 over the words that are in no run's second or later period;
    n_words and n_dropped. ``times`` is 2 or more.
    """
    if times < 2:
        raise ValueError("a run repeats its period, so times is 2 at least")
    ship(spark)
    return own(docs, "doc_id", "text").mapInArrow(partial(_found, loops=loops, least=least, times=times), SCHEMA)
