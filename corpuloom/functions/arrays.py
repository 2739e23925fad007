"""Dense and sparse vector functions, as column expressions over arrays and (idx, val) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scale(a: Column, b: Column | float) -> Column:
    return F.transform(a, lambda x: x * b)


def add_scaled(a: Column, b: Column, weight: Column | float) -> Column:
    """a + weight * b"""
    return F.zip_with(a, b, lambda x, y: x + weight * y)


def difference(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """a - b, null if they differ nowhere by more than the tolerance."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.when(F.exists(d, lambda x: F.abs(x) > tolerance), d)


def l1_normalized(a: Column) -> Column:
    """Over the sum where that is positive."""
    s = total(a)
    return F.when(s > 0, F.transform(a, lambda x: x / s)).otherwise(a)


def l1_absolute(a: Column) -> Column:
    return l1_normalized(F.transform(a, F.abs))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(a: Column) -> Column:
    n = l2_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mahalanobis(a: Column, b: Column, matrix: Column) -> Column:
    """(a - b)' M (a - b)"""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return dot(d, F.transform(matrix, lambda row: dot(row, d)))


def matrix_times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, v))


def kl(p: Column, q: Column) -> Column:
    """sum p ln(p / q) where both are positive."""
    return total(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(F.lit(0.0))))


def kl_symmetric(p: Column, q: Column) -> Column:
    return kl(p, q) + kl(q, p)


def entropy(p: Column, log_scale: bool = False) -> Column:
    if log_scale:
        return -total(F.transform(p, lambda x: F.exp(x) * x))
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))))


def log_sum_exp(a: Column) -> Column:
    """Infinite members are left out; null for none."""
    finite = F.filter(a, lambda x: (x > float("-inf")) & (x < float("inf")))
    m = F.array_max(finite)
    return m + F.ln(F.aggregate(finite, F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sign01(x: Column) -> Column:
    return F.when(x >= 0, 1).otherwise(0)


def encode_bits(bits: Column) -> Column:
    """0/1 flags to an integer, the first one lowest."""
    indexed = F.transform(bits, lambda b, i: F.when(b > 0, F.pow(F.lit(2.0), i.cast("double"))).otherwise(F.lit(0.0)))
    return total(indexed).cast("long")


def triangle_index(i: Column, j: Column) -> Column:
    """Place of the pair (i, j), j < i, in a lower triangle."""
    hi, lo = F.greatest(i, j), F.least(i, j)
    return (F.floor(hi * (hi - 1) / 2) + lo).cast("long")


def argmax(a: Column) -> Column:
    """Place of the first greatest member, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def sorted_descending(a: Column) -> Column:
    return F.sort_array(a, asc=False)


# Sparse vectors: array<struct<idx, val>> in order of idx.


def sparse(dense: Column) -> Column:
    pairs = F.transform(dense, lambda v, i: F.struct(i.cast("int").alias("idx"), v.cast("double").alias("val")))
    return F.filter(pairs, lambda p: p["val"] != 0)


def sparse_map(vector: Column) -> Column:
    return F.map_from_entries(vector)


def sparse_from_map(m: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("idx"), e["value"].alias("val"))))


def negative(vector: Column) -> Column:
    return F.transform(vector, lambda p: F.struct(p["idx"].alias("idx"), (-p["val"]).alias("val")))


def sparse_get(vector: Column, idx: Column | int) -> Column:
    return F.coalesce(F.get(F.filter(vector, lambda p: p["idx"] == idx), F.lit(0))["val"], F.lit(0.0))


def sparse_difference(a: Column, b: Column) -> Column:
    """a - b over the indices of both."""
    every = F.array_sort(F.array_union(a["idx"], b["idx"]))
    return F.filter(
        F.transform(every, lambda i: F.struct(i.alias("idx"), (sparse_get(a, i) - sparse_get(b, i)).alias("val"))), lambda p: p["val"] != 0
    )


def sparse_dense_dot(vector: Column, dense: Column, bias: bool = False) -> Column:
    """Sum over the sparse entries of dense[idx] * val; with a bias dense[0] stands for 1 and the rest is shifted."""
    shift = 2 if bias else 1
    s = F.aggregate(vector, F.lit(0.0), lambda acc, p: acc + F.coalesce(F.element_at(dense, p["idx"] + shift), F.lit(0.0)) * p["val"])
    return s + F.element_at(dense, 1) if bias else s


def jaccard(a: Column, b: Column) -> Column:
    """Over sets of indices; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def libsvm_row(label: Column, vector: Column) -> Column:
    """'y idx:val ...' with indices from 1."""
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(vector, lambda p: F.concat_ws(":", (p["idx"] + 1).cast("string"), p["val"].cast("string"))), " "))


def with_bias(vector: Column, size: int) -> Column:
    """Indices from 1 and a trailing bias feature of 1 at size + 1."""
    shifted = F.transform(vector, lambda p: F.struct((p["idx"] + 1).alias("idx"), p["val"].alias("val")))
    return F.concat(shifted, F.array(F.struct(F.lit(size + 1).alias("idx"), F.lit(1.0).alias("val"))))
