"""Vectorised numpy kernels over UTF-8 text: word hashes, rolling hashes, sliding minima.

Words of the contracts are what bytes.split() gives: it splits on \\x20 and \\x09-\\x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
TOP = U64(0xFFFFFFFFFFFFFFFF)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD[0]))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U64(b), U64)
            steps[0] = U64(1)
            made.append(np.cumprod(steps, dtype=U64))
        have = _powers[base] = (made[0], made[1])
    return have


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each span data[start:end], whatever its position."""
    p, inv = powers(base, len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(_ODD[1]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive hashes, put together from runs of powers of two; mixing in between leaves nothing linear to cancel."""
    if len(h) < n:
        return np.empty(0, U64)
    size = len(h) - n + 1
    out, at, run, width = None, 0, mix(h ^ U64(_ODD[2])), 1
    while True:
        if n & width:
            part = run[at : at + size]
            out = part if out is None else mix(out * U64(_ODD[0]) + part)
            at += width
        if width * 2 > n:
            return out
        run = mix(run[:-width] * U64(_ODD[1]) + run[width:])
        width *= 2


def sliding(x: np.ndarray, n: int, op=np.minimum) -> np.ndarray:
    """op over each window of n values, by doubling."""
    if len(x) < n:
        return x[:0]
    out, have = x, 1
    while have * 2 <= n:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = n - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in some [start, start + width)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0


def texts(column: pa.Array):
    """The UTF-8 bytes of each value of a string column, None for null, without making str objects."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield bytes(raw[at[i] : at[i + 1]]) if valid[i] else None


def bounded(batches, rows: int = 256):
    """The batches in slices of few rows, so that what a kernel holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)
