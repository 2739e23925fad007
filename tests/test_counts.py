"""Terms counted where their texts lie: what tokens, shuffled and counted, give."""

from corpuloom.operators import corpus as C

TEXTS = [
    (1, "Good, very good FOOD 12 caf\u00e9! 007 a_b ... \u2014 ; x-y x--y the The"), (1, "good food"), (2, None), (3, ""), (4, "\t\n\u00a0 \u2003 ?!"), (None, "no key"), (None, "key"),
    (5, "x" * 19 + " " + "y" * 20 + " " + "9" * 30 + " 1.5 NUM num \U0001f600ok \x00z\x1fz"), (6, "a\u2014b c\u2014 \u2014d. \u2014 e good \u2014 food"),
]


def test_text_counts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    tokens = C.tokens(docs)
    for n, mode in ((1, "any"), (2, "any"), (2, "all"), (3, "any"), (3, "all")):
        want = C.term_counts(tokens, n, ("the", "very"), mode)
        got = C.text_counts(docs, n, ("the", "very"), mode)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per token is shuffled


def test_sentences_are_numbered_by_boundaries(spark):
    docs = spark.createDataFrame([(1, "a good, good day \u2014 sun ... sun; 7"), (2, None)], "doc_id long, text string")
    got = {tuple(r) for r in C.text_counts(docs, 1, ("sun",), sentences=True).collect()}
    assert got == {(1, 0, "good", 1), (1, 1, "good", 1), (1, 1, "day", 1), (1, 4, "NUM", 1)}
