"""Gamma functions and sequence functions that Catalyst lacks, vectorized in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the Stirling series, from the Bernoulli numbers B(2n).
_B = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def _lifted(x: np.ndarray, term):
    """x moved to 10 and more by its recurrence; the sum of what that takes."""
    x = np.array(x, float)
    moved = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        moved = np.where(low, moved + term(np.where(low, x, 1.0)), moved)
        x = np.where(low, x + 1, x)
    return x, moved


def lgamma(x) -> np.ndarray:
    z, moved = _lifted(x, np.log)
    series = sum(b / (2 * n * (2 * n - 1) * z ** (2 * n - 1)) for n, b in enumerate(_B, 1))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - moved


def digamma(x) -> np.ndarray:
    z, moved = _lifted(x, lambda t: 1 / t)
    return np.log(z) - 1 / (2 * z) - sum(b / (2 * n * z ** (2 * n)) for n, b in enumerate(_B, 1)) - moved


def trigamma(x) -> np.ndarray:
    z, moved = _lifted(x, lambda t: 1 / t**2)
    return 1 / z + 1 / (2 * z**2) + sum(b / z ** (2 * n + 1) for n, b in enumerate(_B, 1)) + moved


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def g(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield pd.Series(f(v.to_numpy(float)))

    return g


lgamma_udf, digamma_udf, trigamma_udf = map(_udf, (lgamma, digamma, trigamma))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    places: dict = {}
    codes = [np.array([places.setdefault(t, len(places)) for t in side]) for side in (a, b)]
    if not len(codes[0]) or not len(codes[1]):
        return 0
    row = np.zeros(len(codes[1]) + 1, int)
    for token in codes[0]:
        take = row[:-1] + (codes[1] == token)
        row[1:] = np.maximum.accumulate(np.maximum(take, row[1:]))
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)])
