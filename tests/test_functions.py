"""Column functions and numpy kernels against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.functions import arrays as A
from corpuloom.functions import special as S
from corpuloom.functions import text as X
from corpuloom.functions.stemming import stem


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_tokens_and_boundaries(spark):
    tokens = one(spark, X.normalized(F.col("t")), t="Good, very good FOOD 12 café!")
    assert tokens == ["good", "", "very", "good", "food", "NUM", "caf", ""]
    grams = one(spark, X.ngrams(X.normalized(F.col("t")), 2, ("very",)), t="good , very good food")
    assert sorted(grams) == ["food", "good", "good", "good-food", "very-good"]  # not across the comma
    strict = one(spark, X.ngrams(X.normalized(F.col("t")), 2, ("very",), "all"), t="good , very good food")
    assert sorted(strict) == ["food", "good", "good", "good-food"]
    assert one(spark, X.ngrams(X.normalized(F.col("t")), 3), t="") == []
    long = "x" * 20
    assert one(spark, X.ngrams(X.normalized(F.col("t")), 2), t=f"{long} ab") == ["ab", f"{long}-ab"]  # only parts are tested for length


def test_text_functions(spark):
    assert one(spark, X.count_overlapping(F.col("t"), "aa"), t="aaaa") == 3
    assert one(spark, X.count_overlapping(F.col("t"), "."), t="a.b.") == 2
    assert one(spark, X.clean_html(F.col("t")), t="<!-- a\nb -->") is None
    assert one(spark, X.clean_html(F.col("t")), t="x <!-- a --> y") == "x  y"
    assert one(spark, X.clean_video(F.col("t")), t="a // <![CDATA[ zz Length:: 3 Mins b") == "a  b"
    assert one(spark, X.ends_with_punctuation(F.col("t")), t="a.") is True
    assert one(spark, X.json_string(F.col("t"), "b"), t='{"a": 1}') == "NULL"
    assert [one(spark, X.clamp_rating(F.col("t")), t=t) for t in ("None", "4.0", "9", "0", "x")] == [-1, 4, 5, 1, -1]
    assert one(spark, X.format_array(F.col("t")), t=[1.0, 2.5]) == "(1.0,2.5)"
    assert one(spark, X.nfkc(F.col("t")), t="ﬁx") == "fix"


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    value = lambda c, **v: one(spark, c, **v)
    assert value(A.cosine(a, b), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert value(A.cosine(a, b), a=[0.0, 0.0], b=[4.0, 3.0]) == 0
    assert value(A.l1_normalized(a), a=[1.0, 3.0]) == [0.25, 0.75]
    assert value(A.l2_normalized(a), a=[0.0, 0.0]) == [0.0, 0.0]
    assert value(A.difference(a, b), a=[1.0], b=[1.0]) is None
    assert value(A.kl_symmetric(a, b), a=[0.5, 0.5, 0.0], b=[0.25, 0.25, 0.5]) == pytest.approx(math.log(2) * 0.5)
    assert value(A.log_sum_exp(a), a=[float("-inf"), 0.0, 0.0]) == pytest.approx(math.log(2))
    assert (value(A.argmax(a), a=[1.0, 5.0, 5.0]), value(A.argmin(a), a=[1.0, 0.0, 0.0])) == (1, 1)
    assert value(A.encode_bits(a), a=[1, 0, 1]) == 5
    assert value(A.triangle_index(a, b), a=3, b=1) == value(A.triangle_index(a, b), a=1, b=3) == 4
    assert value(A.sign01(a), a=0.0) == 1
    assert [tuple(p) for p in value(A.sparse(a), a=[0.0, 2.0, 0.0, 1.0])] == [(1, 2.0), (3, 1.0)]
    assert [tuple(p) for p in value(A.sparse_difference(A.sparse(a), A.sparse(b)), a=[1.0, 2.0, 0.0], b=[1.0, 0.0, 3.0])] == [(1, 2.0), (2, -3.0)]
    assert value(A.sparse_dense_dot(A.sparse(a), b, bias=True), a=[0.0, 2.0], b=[10.0, 1.0, 3.0]) == 16
    assert value(A.libsvm_row(F.lit(1), A.sparse(a)), a=[0.0, 2.0]) == "1 2:2.0"
    assert [tuple(p) for p in value(A.with_bias(A.sparse(a), 2), a=[0.0, 2.0])] == [(2, 2.0), (3, 1.0)]
    assert value(A.entropy(a), a=[0.5, 0.5]) == pytest.approx(math.log(2))
    assert value(A.jaccard(a, b), a=[1, 2], b=[2, 3]) == pytest.approx(1 / 3)


def test_special_functions(spark):
    x = np.array([0.1, 0.5, 1.0, 2.5, 9.9, 30.0])
    assert S.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-12)
    assert S.digamma(x) == pytest.approx([(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], rel=1e-5)
    assert S.trigamma(np.array([1.0])) == pytest.approx(math.pi**2 / 6)
    assert spark.range(1).select(S.digamma_udf(F.lit(1.0))).first()[0] == pytest.approx(-0.5772156649)
    assert S.lcs(list("abcbdab"), list("bdcaba")) == 4 and S.lcs([], ["a"]) == 0


@pytest.mark.parametrize(
    "word,want",
    [("consistency", "consist"), ("knives", "knive"), ("hopping", "hop"), ("hoping", "hope"), ("generally", "general"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"),
     ("skies", "sky"), ("electricity", "electr"), ("communism", "communism"), ("adoption", "adopt"), ("rate", "rate"), ("beauty", "beauti"), ("by", "by"), ("relational", "relat")],
)
def test_porter2(word, want):
    assert stem(word) == want
