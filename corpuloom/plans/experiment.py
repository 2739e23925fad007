"""The flagship experiment from the command line: load, split, fit the joint embedding, evaluate, write.

    spark-submit corpuloom/plans/experiment.py -prefix DIR -data NAME -mode cv4doc -kFold 0
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.operators import corpus as C
from corpuloom.operators import embedding as E
from corpuloom.operators import network as N
from corpuloom.operators import topics as M
from corpuloom.sources import files, sinks

FLAGS = ("alpha", "gamma", "beta", "tau", "xi", "rho")
DEFAULT_ON = ("alpha", "beta")
MODES = ("cv4doc", "cv4edge", "ansrec")


@dataclass
class Settings:
    prefix: str
    data: str
    save_dir: str
    mode: str
    cold_start: bool
    fold: int
    params: E.Params


def parse(argv: list[str]) -> Settings:
    truth = lambda s: s.lower() in ("true", "1", "yes")
    p = argparse.ArgumentParser(prefix_chars="-")
    p.add_argument("-prefix", default="./data")
    p.add_argument("-data", default="YelpNew")
    p.add_argument("-saveDir", default="./data/output/")
    p.add_argument("-mode", default="cv4doc", choices=MODES, type=str.lower)
    p.add_argument("-coldStart", default=False, type=truth)
    p.add_argument("-multi", default=True, type=truth, help="accepted; Spark is parallel anyway")
    p.add_argument("-ada", default=False, type=truth)
    for name, kind, value in (("kFold", int, 0), ("nuTopics", int, 10), ("dim", int, 10), ("emIter", int, 50), ("varIter", int, 10), ("trainInferIter", int, 1),
                              ("testInferIter", int, 1500), ("paramIter", int, 20), ("stepSize", float, 1e-3), ("gamma", float, 0.1)):
        p.add_argument(f"-{name}", default=value, type=kind)
    for f in FLAGS:
        p.add_argument(f"-{f}Flag", default=f in DEFAULT_ON, type=truth)
    a = p.parse_args(argv)
    flags = frozenset(f for f in FLAGS if getattr(a, f"{f}Flag"))
    params = E.Params(
        topics=a.nuTopics, dim=a.dim, em_rounds=a.emIter, var_rounds=a.varIter, train_rounds=a.trainInferIter, test_rounds=a.testInferIter, step=a.stepSize, gamma=a.gamma, flags=flags, adagrad=a.ada
    )
    return Settings(a.prefix, a.data, a.saveDir, a.mode, a.coldStart, a.kFold, params)


def load(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame, int]:
    """posts as documents (doc_id, user_id, ord, fold, idx, tf), symmetric edges, vocabulary size."""
    base = f"{s.prefix.rstrip('/')}/{s.data}"
    vocab, n = files.vocabulary(spark, f"{base}/{s.data}CV.txt")
    read = files.user_threads if "stack" in s.data.lower() else files.user_reviews
    posts = read(spark, f"{base}/Users").withColumn("doc_id", F.xxhash64("user_id", "ord"))
    counts = C.term_counts(C.tokens(posts), n)
    kept = C.admitted(C.closed(counts, vocab), 5)  # more than five features
    docs = M.corpus(kept).join(posts.select("doc_id", "user_id", "ord"), "doc_id")
    if s.mode == "cv4doc":
        name = "ColdStartCVIndex" if s.cold_start else "CVIndex"
        docs = files.with_folds(docs, files.document_folds(spark, f"{base}/{s.data}{name}.txt"))
    else:
        docs = docs.withColumn("fold", F.lit(-1))  # without a fold file all documents are learned from
    edges = N.symmetric(files.adjacency(spark, f"{base}/{s.data}Friends.txt"), posts)
    return docs, edges, vocab.count()


def run(spark: SparkSession, s: Settings) -> dict[str, float]:
    docs, edges, size = load(spark, s)
    test = F.col("fold").isin(0, 1, 2) if s.cold_start else F.col("fold") == s.fold
    fitted = E.fit(spark, docs.where(~test), edges, size, s.params, users=docs.select("user_id"))
    figures: dict[str, float] = {}
    if s.mode == "cv4doc":
        held = E.infer(spark, docs.where(test), fitted).join(docs.select("doc_id", "fold"), "doc_id")
        by = ["fold"] if s.cold_start else None
        for row in M.perplexity(held, by).collect():  # one row, or one per stratum
            figures[f"perplexity_{row['fold']}" if by else "perplexity"] = row["perplexity"]
    out = f"{s.save_dir.rstrip('/')}/{s.data}_fold_{s.fold}"
    sinks.run_tables(out, user_embedding=fitted.users, documents=fitted.docs)
    sinks.embeddings(fitted.users, f"{out}/embedding_dim_{s.params.dim}_fold_{s.fold}")
    sinks.topic_terms(spark, fitted.state.log_beta.tolist(), f"{out}/beta")
    spark.createDataFrame([(k, float(v)) for k, v in figures.items()] or [("none", 0.0)], "metric string, value double").write.mode("overwrite").parquet(f"{out}/metrics")
    return figures


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("joint-embedding").getOrCreate()
    print(run(session, parse(sys.argv[1:])))
