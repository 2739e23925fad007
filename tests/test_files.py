"""Sources and sinks on hand-made files."""

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import linear
from corpuloom.plans import experiment
from corpuloom.sources import files, sinks
from corpuloom.streaming import ingest


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    return write


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def read(path):
    return sorted(line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines())


def test_vocabularies(spark, put):
    vocab, n = files.vocabulary(spark, put("v.txt", "#NGram:2\n#other\nalpha\nbeta-x\n"))
    assert n == 2 and rows(vocab, "idx") == [("alpha", 0), ("beta-x", 1)]
    old, total, n = files.old_vocabulary(spark, put("o.csv", "TOTALDF,99,0,0\na,5,2,3\nb-c,4,1,3\n"))
    assert (total, n) == (99, 2) and rows(old, "idx") == [("a", 0, 2, 3), ("b-c", 1, 1, 3)]
    assert rows(files.term_list(spark, put("s.txt", "the\n\n and \n")), "term") == [("and",), ("the",)]


def test_user_reviews(spark, put, tmp_path):
    def record(i, rating):
        return f"item{i}\ntext {i}\ncat\n{rating}\n{1000 + i}\n"

    put("Users/u1.x.txt", "name\n" + "".join(record(i, r) for i, r in enumerate([1, 2, 3, 4, 5])))
    put("Users/u2.txt", "name\n" + record(0, 3) + record(1, 5))  # one post survives
    put("Users/u3.dat", "name\n" + record(0, 1) * 3)  # another suffix
    got = files.user_reviews(spark, str(tmp_path / "Users"))
    assert rows(got.select("user_id", "ord", "item_id", "rating", "y", "ts"), "ord") == [
        ("u1", 0, "item0", 1, 0, 1000), ("u1", 1, "item1", 2, 0, 1001), ("u1", 2, "item3", 4, 1, 1003), ("u1", 3, "item4", 5, 1, 1004)
    ]
    put("Stack/u9.txt", "name\n7\nhow\n-1\n0\n50\n8\nso\n7\n1\n60\n")
    assert rows(files.user_threads(spark, str(tmp_path / "Stack")).select("post_id", "parent_id", "ts"), "post_id") == [(7, -1, 50), (8, 7, 60)]
    put("plain/pos/a.txt", "x\ny")
    put("plain/neg/b.txt", "z")
    assert rows(files.plain_documents(spark, str(tmp_path / "plain")).select("text", "y"), "text") == [("xy", 1), ("z", 0)]


def test_lists(spark, put, tmp_path):
    assert rows(files.adjacency(spark, put("f.txt", "a\tb\tc\nd\n")), "dst") == [("a", "b"), ("a", "c")]
    folds = files.document_folds(spark, put("cv.txt", "u,0,1\nu,1,2\n"))
    posts = spark.createDataFrame([("u", 0), ("u", 2)], "user_id string, ord int")
    assert rows(files.with_folds(posts, folds), "ord") == [("u", 0, 1), ("u", 2, -1)]
    for s in ("light", "medium", "heavy"):
        put(f"g_{s}.txt", f"{s}1\tx\n")
    assert rows(files.strata(spark, str(tmp_path / "g")), "user_id") == [("heavy1", "heavy"), ("light1", "light"), ("medium1", "medium")]
    put("W/u1.weights", "1,2,3")
    put("W/u2.weights", "1,2")
    assert rows(files.user_weights(spark, str(tmp_path / "W"), "weights", 2), "user_id") == [("u1", [1.0, 2.0, 3.0])]
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    assert rows(files.user_vectors(spark, put("svd.txt", "h\nh\nh\na 1 2\n"), users, dim=2), "user_id") == [("a", [1.0, 2.0]), ("b", [0.0, 0.0])]
    vocab = spark.createDataFrame([("good", 0), ("bad", 1)], "term string, idx int")
    assert rows(files.seed_words(spark, put("p.txt", "quality good fine\nprice bad\n"), vocab, 5.0), "topic") == [(0, "quality", 0, 5.0), (1, "price", 1, 5.0)]
    assert rows(files.topic_terms(spark, put("b.txt", "2\t2\n-1.0\t-2.0\n-3.0\t-4.0\n")), "k", "idx") == [(0, 0, -1.0), (0, 1, -2.0), (1, 0, -3.0), (1, 1, -4.0)]
    phi = files.document_topics(spark, put("phi.txt", "-----\nu1 3 2 2\n0.1 0.9\n0.5 0.5\n-----\nu2 0 1 2\n1 0\n"))
    assert rows(phi, "user_id", "n") == [("u1", 3, 0, [0.1, 0.9]), ("u1", 3, 1, [0.5, 0.5]), ("u2", 0, 0, [1.0, 0.0])]


def test_json(spark, put, tmp_path):
    put("j/p1.json", '{"asin": "A", "Reviews": [{"Overall": "5.0", "Date": "January 02,2010", "Content": "nice", "Title": "wow", "ReviewID": "r1", "Author": "x"},'
        '{"Overall": "3", "Date": "2010-01-03", "Content": "meh", "ReviewID": "r2", "Author": "y"}, {"Overall": "None", "Date": "2010-01-03", "Content": "no", "ReviewID": "r3"}]}')
    put("j/bad.json", "{not json")
    got = files.json_reviews(spark, str(tmp_path / "j"), product="asin")
    assert rows(got.select("item_id", "review_id", "rating", "y"), "review_id") == [("A", "r1", 5, 1), ("A", "r2", 3, 0)]
    assert rows(files.titled(got).select("review_id", "text", "y"), "review_id") == [("r1", "wow. nice", 4), ("r2", "meh", 2)]
    seg = files.segmented_reviews(spark, put("n.json", '{"Rating": "9", "Pros": "p", "LoginNickName": "z"}\n'), "prod")
    assert rows(seg.select("review_id", "rating", "segments"), "rating") == [("prod-z", 5, ["p", "NULL", "NULL"])]
    assert rows(files.products(spark, put("q.json", '{"ProductID": "1", "Price": "2"}\n')), "item_id") == [("1", "NULL", "2", "NULL")]


def test_lexicon(spark, put):
    lexicon = files.sentiment_lexicon(spark, put("swn.txt", "# c\na\t1\t0.5\t0.25\tfine#1 good#2\tgloss\na\t2\t1\t0\tgood#1\tgloss\nn\t3\t0\t0\tthing#1\tgloss\nbroken\tline\n"))
    got = {(t, p): s for t, p, s in rows(lexicon, "term")}
    assert got[("fine", "a")] == 0.25 and got[("thing", "n")] == 0
    assert got[("good", "a")] == pytest.approx((1 / 1 + 0.25) / 2)  # the running mean
    tokens = spark.createDataFrame([(1, "good", "JJ"), (1, "xyz", "NN"), (1, "fine", "JJR")], "doc_id long, term string, tag string")
    assert files.sentiment_score(tokens, lexicon).first()["score"] == pytest.approx((0.625 + 0.25) / 3)
    assert rows(files.tagged_counts(tokens), "term") == [(1, "fine", 1), (1, "good", 1)]


def test_libsvm_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, [(0, 2.0), (3, 0.5)], "n1"), (0.0, [(1, 1.0)], "n2")], "y double, features array<struct<idx:int,val:double>>, name string")
    sinks.libsvm(df, str(tmp_path / "l"))
    assert read(tmp_path / "l") == ["0.0 2:1.0 #n2", "1.0 1:2.0 4:0.5 #n1"]
    one = next((tmp_path / "l").glob("part-*"))
    back = files.libsvm(spark, str(tmp_path / "l"))
    assert one and rows(back.select("y", "idx", "val", "name"), "y") == [(0.0, [1], [1.0], "n2"), (1.0, [0, 3], [2.0, 0.5], "n1")]


def test_sinks(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    vocab = spark.createDataFrame([("b", 1), ("a", 0)], "term string, idx int")
    sinks.vocabulary(vocab, out("v"), ngram=2)
    parts = [p for p in (tmp_path / "v").glob("part-*") if p.stat().st_size]
    assert len(parts) == 1 and parts[0].read_text().splitlines() == ["#NGram:2", "a", "b"]
    again, n = files.vocabulary(spark, out("v"))
    assert n == 2 and again.count() == 2
    stats = sinks.vocabulary_stats(spark.createDataFrame([("a", 1, 2, 3, 4), ("b", 3, 4, 5, 6)], "term string, df_0 int, df_1 int, ttf_0 int, ttf_1 int"), out("vs")).first()
    assert (stats["max_df_0"], stats["sum_ttf_1"]) == (3, 10) and read(tmp_path / "vs")[0] == "a\t1\t2\t3\t4"
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "a")], "src string, dst string")
    sinks.adjacency(edges, out("adj"))
    assert read(tmp_path / "adj") == ["a\tb\tc", "b\ta"]
    posts = spark.createDataFrame([("a", 0, -1, "x\ny"), ("a", 1, 3, "z"), ("b", 0, 2, "w")], "user_id string, ord int, fold int, text string")
    sinks.document_folds(posts, out("cv"))
    assert read(tmp_path / "cv") == ["a,0,1", "a,1,3", "b,0,2"]
    strata = spark.createDataFrame([("a", "medium")], "user_id string, stratum string")
    sinks.cold_start_documents(posts, strata, out("cold"))
    assert read(tmp_path / "cold") == ["a,0,1", "a,1,1", "b,0,3"]
    sinks.cold_start_edges(edges, strata, out("colde"))
    assert read(tmp_path / "colde") == ["b\ta"]
    sinks.token_bags(spark.createDataFrame([("a", 2, 2), ("a", 1, 1)], "user_id string, idx int, tf long"), out("bag"))
    assert read(tmp_path / "bag") == ["a 1 2 2"]
    sinks.aggregated_texts(posts, out("agg"))
    assert read(tmp_path / "agg") == ["a\tx y z", "b\tw"]
    train, test = sinks.rated_candidates(edges.limit(1), edges.limit(1), edges)
    assert train.count() == 2 and test.count() == 4
    sinks.rating_pairs(train, out("pairs"))
    sinks.query_lists(edges, out("q"), "src", "dst")
    assert read(tmp_path / "q") == ["a\tb\tc", "b\ta"]
    sinks.embeddings(spark.createDataFrame([("u", [0.123456, 1.0])], "user_id string, mu array<double>"), out("emb"))
    assert read(tmp_path / "emb") == ["1\t2", "u\t0.1235\t1.0000"]
    sinks.topic_terms(spark, [[-1.0, -2.0], [-3.0, -4.0]], out("beta"), 1)
    assert rows(files.topic_terms(spark, out("beta")), "k", "idx")[0] == (0, 0, -1.0)
    import numpy as np

    model = linear.Linear(np.array([[1.0, 2.0]]), [0.0, 1.0], "logistic")
    sinks.linear_model(spark, model, out("lm"))
    back = sinks.load_linear(spark, out("lm"))
    assert back.classes == model.classes and (back.weights == model.weights).all() and back.loss == "logistic"


def test_experiment(spark, put, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    put("d/Toy/ToyCV.txt", "#NGram:1\n" + "\n".join(words) + "\n")
    folds = []
    for u in range(4):
        body = "".join(f"i{k}\n{' '.join(words[(u + k + j) % 8] for j in range(7))}\nc\n5\n{k}\n" for k in range(5))
        put(f"d/Toy/Users/u{u}.txt", "n\n" + body)
        folds += [f"u{u},{k},{k}" for k in range(5)]
    put("d/Toy/ToyCVIndex.txt", "\n".join(folds) + "\n")
    put("d/Toy/ToyFriends.txt", "u0\tu1\tu2\nu3\tu0\tzz\n")
    s = experiment.parse(f"-prefix {tmp_path}/d -data Toy -saveDir {tmp_path}/out -nuTopics 2 -dim 2 -emIter 1 -varIter 1 -testInferIter 3 -kFold 1".split())
    assert s.params.flags == {"alpha", "beta"} and s.mode == "cv4doc" and experiment.parse([]).params.test_rounds == 1500
    figures = experiment.run(spark, s)
    assert 1 < figures["perplexity"] < 1000
    assert spark.read.parquet(f"{tmp_path}/out/Toy_fold_1/user_embedding").count() == 4


def test_streaming(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 50").write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.count_terms(ingest.documents(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    docs.where("doc_id between 50 and 80").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    from corpuloom.operators import corpus as C

    want = C.term_counts(C.tokens(docs.where("doc_id <= 80").select("doc_id", "text")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() and got.agg(F.sum("tf")).first() == want.agg(F.sum("tf")).first()


def test_packed_files(spark, tmp_path):
    """A file per owner, whatever its name, in no more files than tasks; of another suffix none is read."""
    names = ["a b", "x+y", "c%d:e", "u/v", "ü"]
    whole = spark.createDataFrame([(n, f"{i},1") for i, n in enumerate(names)], "k string, v string")
    path = sinks.packed_files(whole, "k", "v", str(tmp_path / "owners"), ".weights")
    assert rows(files.user_weights(spark, path, "weights", 1), "w") == [(n, [float(i), 1.0]) for i, n in enumerate(names)]
    assert files.directory(spark, path).count() == 0


def test_long_files(spark, tmp_path):
    """Files of many records are cut once, not once per record."""
    import json
    import time

    n = 20_000
    (tmp_path / "u.txt").write_text("name\n" + "".join(f"item{i}\ntext\ncat\n{i % 2 * 4 + 1}\n{i}\n" for i in range(n)))
    (tmp_path / "p.json").write_text(json.dumps({"asin": "p", "Reviews": [{"Overall": "5", "Date": "2020-01-01", "Content": "c", "Title": "t", "ReviewID": str(i)} for i in range(n)]}))
    begun = time.time()
    assert files.user_reviews(spark, str(tmp_path)).agg(F.count("item_id"), F.max("ord")).first()[:] == (n, n - 1)
    got = files.titled(files.json_reviews(spark, str(tmp_path), product="asin")).select("item_id", "review_id", "text", "y")
    assert got.agg(F.countDistinct("review_id"), F.min("item_id"), F.max("text")).first()[:] == (n, "p", "t. c")
    assert time.time() - begun < 60
