"""The pipeline, stage by stage, against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpuloom.llm import langid, packing, simhash
from tests.llm import reference as R
from tests.llm.test_operators import SCHEMA, awkward, plain_language


@pytest.mark.parametrize("which", ["table", "awkward", "empty"])
def test_stages(spark, sf, which):
    if which == "table":
        docs = spark.read.parquet(f"{sf}/documents.parquet")
    else:
        docs = spark.createDataFrame(awkward() if which == "awkward" else [], SCHEMA)
    stages = dict(P.STAGES)
    rows = lambda df: [tuple(r) for r in df.select(*P.COLUMNS).collect()]
    whole = rows(docs)

    after = rows(stages["language_id"](spark, docs, sf))
    model = langid.fit(spark, docs)
    assert Counter(after) == Counter(r for r in whole if model is not None and not plain_rejects(model, r[1]))
    if which == "table":
        assert len(after) >= 0.98 * len([r for r in whole if any(c.isalpha() for c in r[1] or "")]) - 2

    got = Counter(rows(stages["exact_dedup"](spark, docs, sf)))
    want = [w for w, e in zip(whole, R.exact([(r[0], r[1]) for r in whole])) if e[3]]
    assert Counter((r[0], r[1]) for r in got.elements()) == Counter((r[0], r[1]) for r in want)

    got = Counter(rows(stages["near_dedup"](spark, docs, sf)))
    assert not got - Counter(whole)
    groups = R.wide_groups([r[1] for r in whole], simhash.wide_plan(len(whole), 0.8)[2])
    assert sum(got.values()) == len(set(groups))
    first = defaultdict(lambda: (True, 0))
    for g, r in zip(groups, whole):
        first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert Counter(r[0] for r in got.elements()) == Counter(None if none else d for none, d in first.values())

    got = Counter(rows(stages["source_mix"](spark, docs, sf)))
    wanted = R.mix([(r[0], r[3], len(R.WORD.findall(r[1] or ""))) for r in whole])
    want = Counter()
    for r, (*_, copies) in zip(whole, wanted):
        want[r] += copies
    if which == "table":  # elsewhere rows tie in size and doc_id: either may be taken
        assert got == +want
    assert sum(got.values()) == sum(want.values()) and all(n <= 2 * Counter(whole)[r] for r, n in got.items())

    pieces(stages["packing"](spark, docs, sf).collect(), [(r[0], r[1]) for r in whole])


def pieces(packed, docs):
    """Packed pieces hold each id of each document once, in gapless sequences."""
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[(d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed) == want
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= 2048


def planted(rng, words, changes):
    """A text of words and a copy of it with so many of them replaced, far apart."""
    text = [f"w{i}" for i in rng.integers(0, 10**6, words)]
    copy = list(text)
    for i in range(changes):
        copy[(i * words) // changes + 5] = f"changed{i}"
    return " ".join(text), " ".join(copy)


def test_near_copies_are_caught(spark):
    """Copies of a five-word similarity over 0.8 go, unrelated documents and those under 0.6 stay."""
    rng = np.random.default_rng(14)
    rows, over, under = [], 0, set()
    for i in range(150):
        a, b = planted(rng, 400, int(rng.integers(1, 9)))  # 0.80 to 0.98
        over += R.jaccard(a, b) >= 0.8
        rows += [(len(rows), a), (len(rows) + 1, b)]
        assert R.jaccard(a, b) >= 0.8
    for i in range(60):
        a, b = planted(rng, 400, int(rng.integers(25, 60)))
        assert R.jaccard(a, b) < 0.6
        under |= {len(rows), len(rows) + 1}
        rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA.split(", fp")[0])
    kept = {r[0] for r in dict(P.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert under <= kept
    assert len(rows) - len(kept) >= 0.97 * over and not any({a, a + 1}.isdisjoint(kept) for a in range(0, len(rows), 2))


def test_near_dedup_verifies(spark):
    """What goes has a partner of 0.8 or more in the input, on the tables and on chains of edits; all the pairs of a group count."""
    rng = np.random.default_rng(21)
    text, rows = [f"w{i}" for i in range(300)], []
    for i in range(40):  # each a few words further from the first
        text = list(text)
        for at in rng.integers(0, 300, 4):
            text[at] = f"v{i}_{at}"
        rows.append((i, " ".join(text)))
    base = [f"u{i}" for i in range(300)]
    for i in range(60):  # all at about 0.7 from one another: fingerprints alone would link some
        copy = list(base)
        for at in rng.choice(300, 5, replace=False):
            copy[at] = f"c{i}_{at}"
        rows.append((100 + i, " ".join(copy)))
    texts = [t for _, t in rows] + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").distinct().collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA.split(", fp")[0])
    kept = {r[0] for r in dict(P.STAGES)["near_dedup"](spark, docs, "").collect()}
    groups = R.wide_groups(texts, simhash.wide_plan(len(texts), 0.8)[2])
    assert kept == {groups.index(g) for g in groups}
    gone = [i for i in range(len(texts)) if i not in kept]
    assert gone and all(max(R.jaccard(texts[i], t) for j, t in enumerate(texts) if j != i) >= 0.8 for i in gone)


def test_run(spark, sf):
    """The whole pipeline against its plain version."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS).collect()]
    model = langid.fit(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    docs = [r for r in docs if not plain_rejects(model, r[1])]
    docs = [r for r, e in zip(docs, R.exact([(r[0], r[1]) for r in docs])) if e[3]]
    groups, first = R.wide_groups([r[1] for r in docs], simhash.wide_plan(len(docs), 0.8)[2]), {}
    for g, r in zip(groups, docs):
        first[g] = min(first.get(g, r[0]), r[0])
    docs = [r for g, r in zip(groups, docs) if first[g] == r[0]]
    taken = R.mix([(r[0], r[3], len(R.WORD.findall(r[1] or ""))) for r in docs])
    docs = [r for r, (*_, copies) in zip(docs, taken) for _ in range(copies)]
    assert len(docs) > 100
    pieces(P.run(spark, sf).collect(), [(r[0], r[1]) for r in docs])


def plain_rejects(model, text):
    found = model.probabilities(text or "")
    lang, score = plain_language(model, text)
    if found is None:
        return lang == "und"
    return score < model.score(np.array([model.least]), found[1]) or found[1] < model.least_seen


def test_clashing_columns(spark, sf):
    """Extra columns named like the stages' own, in any case, make no difference."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["TEXT", "Doc_Id", "_digest", "_copies", "_want_id", "_want_key", "fp", "_row", "root", "node", "class", "_lang_pred", "_score", "SOURCE", "_u", "key", "id"]
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in P.STAGES:
        got, want = (stage(spark, d, sf) for d in (wide, docs))
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())), name
