"""Writers of the text formats and of result tables. Text goes out as a folder of part files in Spark's way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions.arrays import libsvm_row
from corpuloom.sources.files import PACKED


def text(rows: DataFrame, line: Column, path: str, order: list[str] | None = None) -> None:
    """One line per row; with an order the files together are in it."""
    out = rows.orderBy(*order) if order else rows
    out.select(line.alias("value")).write.mode("overwrite").text(path)


def named_files(rows: DataFrame, name: str, content: str, path: str, suffix: str = ".txt") -> None:
    """A file per row, named by it: what formats of one file per user or item ask for.

    Tasks write the files into folders of their own in the same place; the driver then renames
    one after the other, which no writer of Spark can do, so this is for few files; ``packed_files`` takes any number.
    """
    spark = rows.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = path.rstrip("/")
    whole = rows.groupBy(F.col(name).cast("string").alias("_file")).agg(F.first(content).alias("value"))
    whole.write.mode("overwrite").partitionBy("_file").text(f"{path}/_parts")
    fs = hadoop.Path(path).getFileSystem(conf)
    for folder in fs.listStatus(hadoop.Path(f"{path}/_parts")):
        key = folder.getPath().getName()
        if key.startswith("_file="):
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), hadoop.Path(f"{path}/{key.removeprefix('_file=')}{suffix}"))
    fs.delete(hadoop.Path(f"{path}/_parts"), True)


def packed_files(rows: DataFrame, name: str, content: str, path: str, suffix: str = ".txt") -> str:
    """What ``named_files`` writes, packed as rows of path and content; returns the folder, which ``files.directory`` takes.

    For any number of files: each one of its own costs a creation, a rename and a place in a listing, which
    at some hundred thousand is most of the time.
    """
    packed = f"{path.rstrip('/')}{PACKED}"
    file = F.concat(F.replace(F.url_encode(F.col(name).cast("string")), F.lit("+"), F.lit("%20")), F.lit(suffix))
    whole = rows.groupBy(file.alias("path")).agg(F.first(content).alias("value"))
    whole.write.mode("overwrite").parquet(packed)
    return packed


def fields(*columns: str | Column, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def vocabulary(vocab: DataFrame, path: str, ngram: int = 1, **config: object) -> None:
    """Comments with the configuration, then the terms in order of idx."""
    spark = vocab.sparkSession
    head = [f"#NGram:{ngram}", *[f"#{k}:{v}" for k, v in config.items()]]
    comments = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "idx long, term string")
    whole = comments.unionByName(vocab.select(F.col("idx").cast("long").alias("idx"), "term"))
    text(whole.repartitionByRange(1, "idx").sortWithinPartitions("idx"), F.col("term"), path)  # a vocabulary is one file: its order is its index


def vocabulary_stats(stats: DataFrame, path: str) -> DataFrame:
    """'term df... ttf...' lines; returns the greatest, mean and total of df and ttf."""
    names = [c for c in stats.columns if c.startswith("df")] + [c for c in stats.columns if c.startswith("ttf")]
    text(stats, fields("term", *names), path)
    return stats.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("max", F.max), ("avg", F.avg), ("sum", F.sum))])


def libsvm(rows: DataFrame, path: str) -> None:
    """rows (y, features of (idx, val), optional name): 'y idx:val ... #name'."""
    line = libsvm_row(F.col("y"), F.col("features"))
    text(rows, F.concat(line, F.lit(" #"), F.col("name")) if "name" in rows.columns else line, path)


def users(index: DataFrame, path: str) -> None:
    text(index, fields("user_id", "u") if "u" in index.columns else F.col("user_id"), path)


def adjacency(edges: DataFrame, path: str) -> None:
    """'uid<TAB>f1<TAB>f2 ...'"""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("f"))
    text(rows, F.concat_ws("\t", F.col("src").cast("string"), F.array_join(F.transform("f", lambda x: x.cast("string")), "\t")), path)


def document_folds(posts: DataFrame, path: str) -> None:
    """'uid,ordinal,fold'; a fold that is not set (-1) is written as 1."""
    text(posts, fields("user_id", "ord", F.when(F.col("fold") == -1, 1).otherwise(F.col("fold")), sep=","), path)


def edge_folds(folds: DataFrame, path: str) -> None:
    text(folds, fields("src", "dst", "fold", sep=","), path)


def cold_start_documents(posts: DataFrame, strata: DataFrame, path: str) -> None:
    """'uid,ordinal,group': 0, 1, 2 for light, medium, heavy users, 3 for others."""
    group = F.coalesce(*[F.when(F.col("stratum") == s, i) for i, s in enumerate(("light", "medium", "heavy"))], F.lit(3))
    text(posts.join(strata, "user_id", "left").withColumn("g", group), fields("user_id", "ord", "g", sep=","), path)


def cold_start_edges(edges: DataFrame, strata: DataFrame, path: str) -> None:
    """Training edges without the sampled users'."""
    adjacency(edges.join(strata.select(F.col("user_id").alias("src")), "src", "left_anti"), path)


def token_bags(counts: DataFrame, path: str, owner: str = "user_id") -> None:
    """Per owner its term indices, each as often as counted."""
    bag = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tf"))), lambda p: F.array_repeat(p["idx"].cast("string"), p["tf"].cast("int"))))
    text(counts.groupBy(owner).agg(bag.alias("b")), F.concat_ws(" ", F.col(owner).cast("string"), F.array_join("b", " ")), path)


def aggregated_texts(posts: DataFrame, path: str) -> None:
    """'uid<TAB>all texts in order'."""
    rows = posts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), " ").alias("t"))
    text(rows, fields("user_id", F.regexp_replace("t", "[\r\n\t]+", " ")), path)


def rating_pairs(pairs: DataFrame, path: str) -> None:
    """CSV user_id,item_id,rating with a header."""
    pairs.select("user_id", "item_id", "rating").write.mode("overwrite").option("header", True).csv(path)


def rated_candidates(train: DataFrame, test: DataFrame, strangers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives in both directions to learn from; test edges as 1 and sampled strangers as 0 to score.

    Edges and strangers are (src, dst). All other users would be a square of them; the strangers are
    the sample that is asked for.
    """
    triple = lambda e, r: e.select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"), F.lit(r).alias("rating"))
    back = train.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return triple(train.unionByName(back).distinct(), 1), triple(test, 1).unionByName(triple(strangers, 0))


def query_lists(rows: DataFrame, path: str, key: str, value: str) -> None:
    """'key<TAB>v1<TAB>v2 ...': test interactions, non-interactions, answers of a question."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("v"))
    text(out, F.concat_ws("\t", F.col(key).cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), "\t")), path)


def matrix(rows: DataFrame, path: str, key: str, vector: str, digits: int = 4, header: str | None = None) -> None:
    """'key v1 v2 ...' with fixed digits, behind an optional header line."""
    number = lambda x: F.format_string(f"%.{digits}f", x)
    line = F.concat_ws("\t", F.col(key).cast("string"), F.array_join(F.transform(vector, number), "\t"))
    body = rows.select(F.lit(1).alias("o"), F.col(key).cast("string").alias("k"), line.alias("l"))
    if header is not None:
        body = rows.sparkSession.createDataFrame([(0, "", header)], "o int, k string, l string").unionByName(body)
    text(body.repartitionByRange(1, "o", "k").sortWithinPartitions("o", "k"), F.col("l"), path)


def embeddings(users_: DataFrame, path: str) -> None:
    """'U<TAB>M' and a row per user."""
    shape = users_.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("mu")).alias("m")).first()
    matrix(users_, path, "user_id", "mu", 4, f"{shape['n']}\t{shape['m']}")


def topic_terms(spark: SparkSession, log_beta, path: str, digits: int = 2) -> None:
    """'K<TAB>V' and K rows of log-probabilities."""
    rows = [(-1, f"{len(log_beta)}\t{len(log_beta[0])}"), *[(k, "\t".join(f"{x:.{digits}f}" for x in row)) for k, row in enumerate(log_beta)]]
    text(spark.createDataFrame(rows, "k int, l string").coalesce(1).sortWithinPartitions("k"), F.col("l"), path)


def topic_words(spark: SparkSession, words: list[tuple[int, int, str, float]], path: str) -> None:
    spark.createDataFrame(words, "topic int, rank int, term string, p double").write.mode("overwrite").parquet(path)


def run_tables(path: str, **tables: DataFrame) -> None:
    """Each result as a Parquet table of the run's folder: user_embedding, topic_embedding, theta, metrics ..."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def linear_model(spark: SparkSession, model, path: str) -> None:
    """Classes and weights of a linear model as a table; load_linear() reads it."""
    rows = [(i, float(model.classes[i]) if i < len(model.classes) else None, model.weights[i].tolist() if i < len(model.weights) else None, model.loss) for i in range(max(len(model.weights), len(model.classes)))]
    spark.createDataFrame(rows, "k int, y double, w array<double>, loss string").write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str):
    import numpy as np

    from corpuloom.operators.linear import Linear

    rows = spark.read.parquet(path).orderBy("k").collect()  # one row per class
    return Linear(np.array([r["w"] for r in rows if r["w"] is not None]), [r["y"] for r in rows if r["y"] is not None], rows[0]["loss"])


def model(spark: SparkSession, fitted, path: str) -> None:
    """Any fitted model of this package (topics, sequences, kernel machines, embeddings, linear): its arrays as rows, the rest as JSON."""
    import dataclasses
    import json

    import numpy as np

    arrays: list = []

    def told(x):
        if isinstance(x, np.ndarray):
            arrays.append(x)
            return {"array": len(arrays) - 1}
        if isinstance(x, np.generic):
            return {"value": x.item()}
        if dataclasses.is_dataclass(x):
            return {"class": f"{type(x).__module__}:{type(x).__qualname__}", "fields": {f.name: told(getattr(x, f.name)) for f in dataclasses.fields(x)}}
        if isinstance(x, dict):
            return {"dict": [[told(k), told(v)] for k, v in x.items()]}
        for kind in (list, tuple, frozenset):
            if isinstance(x, kind):
                return {kind.__name__: [told(v) for v in x]}
        return {"value": x}

    rows = [(-1, json.dumps(told(fitted)), None, None)]
    rows += [(i, a.dtype.str, list(a.shape), a.astype(float).ravel().tolist()) for i, a in enumerate(arrays)]
    spark.createDataFrame(rows, "i int, kind string, shape array<int>, x array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    """What model() wrote; classes of other packages are refused."""
    import importlib
    import json

    import numpy as np

    rows = {r["i"]: r for r in spark.read.parquet(path).collect()}  # as large as the model, which a driver held before

    def made(t):
        (kind, x), *more = t.items()
        if kind == "array":
            return np.array(rows[x]["x"], float).astype(rows[x]["kind"]).reshape(rows[x]["shape"])
        if kind == "class":
            module, name = x.split(":")
            if module.split(".")[0] != __name__.split(".")[0]:
                raise ValueError(f"{x} is no model of this package")
            return getattr(importlib.import_module(module), name)(**{k: made(v) for k, v in more[0][1].items()})
        if kind == "dict":
            return {made(k): made(v) for k, v in x}
        if kind in ("list", "tuple", "frozenset"):
            return {"list": list, "tuple": tuple, "frozenset": frozenset}[kind](made(v) for v in x)
        return x

    return made(json.loads(rows[-1]["kind"]))


def cluster_line(clusters: DataFrame, path: str) -> None:
    """Cluster numbers in order of id as one comma-separated line per part."""
    text(clusters.orderBy("id"), F.col("cluster").cast("string"), path)
