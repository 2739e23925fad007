"""Periodic runs, tokenizer alignment and WARC transactions against plain versions."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.llm import alignment, periodic, warc
from tests.llm.test_operators import awkward, SCHEMA, counted, docs, pairs  # noqa: F401


# ---- runs


def plain_runs(words, least=24, times=3):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, times * q) and not any(q % d == 0 and words[s : s + n - d] == words[s + d : s + n] for d in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n, len(gone),
    )


def test_op11_rows(spark, docs):  # noqa: F811
    small = docs.where(F.length("text").isNull() | (F.length("text") < 20_000))
    got = periodic.detect(spark, small, loops=True)
    assert counted(got.collect()) == counted(plain_periodic(*p) for p in pairs(small))
    assert got.count() == small.count()


def test_op11_kernels():
    """All runs of short random, looped and periodic words, in batches, for three definitions of a run."""
    rng, seen = np.random.default_rng(11), 0
    for _ in range(250):
        batch = []
        for _ in range(int(rng.integers(1, 5))):
            n, k, a, p = (int(rng.integers(lo, hi)) for lo, hi in ((0, 60), (1, 4), (0, 60), (1, 12)))
            w = rng.integers(1, k + 1, n + 12)
            batch.append(np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(n)] if rng.random() < 0.6 and a < n else w[:n], np.int64))
        for least, times in ((24, 3), (2, 2), (6, 2)):
            doc, start, length, period = periodic.runs(batch, least, times)
            for i, w in enumerate(batch):
                here = doc == i
                assert list(zip(start[here].tolist(), length[here].tolist(), period[here].tolist())) == plain_runs(w.tolist(), least, times)
                seen += int(here.sum())
    assert seen > 5000


@pytest.mark.parametrize("kind", ["same", "fibonacci", "loop", "descending"])
def test_op11_long_words(kind):
    """Words that make long ties, long jumps and many runs."""
    n = 60_000
    if kind == "same":
        words, want = np.ones(n, np.int64), [(0, n, 1)]
    elif kind == "loop":
        words = np.tile(np.random.default_rng(1).permutation(n // 10) + 1, 10)
        want = [(0, n, n // 10)]
    elif kind == "descending":
        words, want = np.arange(n, 0, -1), []
    else:
        a, b = [1], [1, 2]
        while len(b) < 2000:
            a, b = b, b + a
        words = np.array(b, np.int64)
        want = plain_runs(b)
    _, start, length, period = periodic.runs([words])
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
    values = -np.arange(2000)  # descending behind a least one: more jumps than rounds
    values[0] = -5000
    assert periodic.next_smaller(values).tolist() == [2000, *range(2, 2000), 2000]


def test_op11_overlapping_runs(spark):
    """A text with runs of several periods that share words, and one that only a neighbour shortens."""
    text = " ".join(["a"] * 30 + ["b", "c", "d"] * 9 + ["b"] + ["x"] + ["e f"] * 11 + ["e"] + ["e f"] * 12)
    rows = [(1, text), (2, "same " * 23), (3, "same " * 24), (None, "same " * 24)]
    got = {r["doc_id"]: r for r in periodic.detect(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2]["n_runs"], got[3]["n_runs"], got[3]["exponent_milli"], got[3]["n_dropped"]) == (0, 1, 24000, 23)
    assert got[None]["n_runs"] == 1 and got[1]["n_runs"] == len(plain_runs(text.split()))
    with pytest.raises(ValueError):
        periodic.detect(spark, spark.createDataFrame(rows, "doc_id long, text string"), times=1)


# ---- alignment


@pytest.fixture(scope="module")
def tools():
    return alignment.both(*alignment._paths(None, None))


def plain_alignment(rows, tools, links):
    """rows of (doc_id, text) -> result rows, token by token."""
    each, counts = [], Counter()
    for doc_id, text in rows:
        groups, found = [], []
        if text:
            whole = (" " + text).encode()
            a = tools.a.encode(" " + text, add_special_tokens=False).ids
            b = tools.b.encode(text)
            letters = {c: x for c, x in alignment.byte_letters().items()}
            bytes_a = [bytes(letters[c] for c in tools.a.id_to_token(i)) for i in a]
            pieces = [tools.b.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                x = y = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    to_x, to_y = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
                    ga, gb, x, y = a[x:to_x], b[y:to_y], to_x, to_y
                    groups.append((ga, gb))
                    found += [(ga[-1], gb[-1])] if links == "end" else [(i, j) for i in ga for j in gb]
        counts.update(found)
        each.append((doc_id, groups, found))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for doc_id, groups, found in each:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(found), sum(counts[p] == best[p[1]] for p in found),
            sum(counts[p] for p in found), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("links", ["end", "group"])
def test_op12_rows(spark, docs, tools, links):  # noqa: F811
    got = alignment.align_tokenizers(spark, docs, links=links).collect()
    assert counted(got) == counted(plain_alignment(pairs(docs), tools, links))


def test_op12_odd_texts(spark, tools):
    rows = list(enumerate(["<s>a</s> <unk> <|endoftext|>", "▁x", "a▁", "é😀\x00\x7f", "  two  spaces  ", "\ttab\nline\r\n", "日本語テキスト", "x" * 3000, "a b" * 9000, " ", "İstanbul ﬁ"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in alignment.align_tokenizers(spark, df).collect()}
    assert got == {r[0]: r for r in plain_alignment(rows, tools, "end")}
    assert got[1][1:] == (0, 0, 0, 0, 0, 0, "") and got[2][1] == 0 and got[0][1] > 5 and got[3][4] > 0


def test_op12_counts_without_broadcast(spark, docs):  # noqa: F811
    """Beyond the bound on pairs the counts come by a shuffle: the same rows."""
    assert counted(alignment.align_tokenizers(spark, docs, most_pairs=0).collect()) == counted(alignment.align_tokenizers(spark, docs).collect())
    with pytest.raises(ValueError):
        alignment.align_tokenizers(spark, docs, links="overlap")


def test_op12_expansion():
    cuts, a, b = alignment.align(np.array([2, 1, 3, 1, 1]), np.array([1, 1, 4, 2]))
    assert (cuts.tolist(), a.tolist(), b.tolist()) == ([2, 6, 8], [0, 1, 1, 2, 2], [0, 0, 1, 2])
    assert [x.tolist() for x in alignment.expand(a, b, 3, "end")] == [[0, 2, 4], [1, 2, 3]]
    assert [x.tolist() for x in alignment.expand(a, b, 3, "group")] == [[0, 0, 1, 2, 3, 4], [0, 1, 2, 2, 3, 3]]


# ---- archives

PAGES = "page_id long, url string, html string, `PAGE_ID` string, record_id long"


def odd_pages():
    mark = warc.MARK + "1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:no>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    texts = [
        None, "", "", "same page", "same page", "same page", "é😀", "\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.", "a" + mark + "b", mark * 3, mark, "x" * 200_000, "x" * 200_000,
        "\r\n" * 70_000, "WARC/1.1\r\n\r\n", "head\r\n\r\nbody", "last\r\n\r\n", "\x00\x01\x7f",
    ]
    rows = [(i * 7 % 20, f"https://h{i % 3}.example/p{i}?q=1", t, "x", i) for i, t in enumerate(texts)]
    rows[3] = (rows[3][0], None, *rows[3][2:])
    rows[6] = (rows[6][0], "https://h.example/a\r\nInjected: yes", *rows[6][2:])
    return rows + [rows[4], rows[4], rows[10], (None, None, None, None, None), (None, None, "same page", None, None), (None, None, "only null", None, None)]


def plain_archive(rows, least=0):
    first = {}
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    used = set()
    for page, html in rows:
        data = (html or "").encode()
        alone = len(data) < least
        again = not alone and (page != first[html or ""] or html in used)
        used.add(html or "") if not again else None
        yield page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None


def plain_again(rows, least=0):
    """As plain_archive, null and empty payloads being the same one."""
    return list(plain_archive([(p, h or "") for p, h in rows], least))


@pytest.mark.parametrize("least", [0, 5])
def test_op13_rows(spark, least):
    rows = odd_pages()
    got = warc.archive(spark, spark.createDataFrame(rows, PAGES).repartition(3), least)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got.columns[:5] == names
    assert counted(got.select(*names).collect()) == counted(plain_again([(r[0], r[2]) for r in rows], least))
    assert got.where("n_requests != 1").count() == 0


def test_op13_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    both = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100_000))
    got = warc.archive(spark, both).drop("n_requests", "target_uri").collect()
    assert counted(got) == counted(plain_again([(r["page_id"], r["html"]) for r in both.collect()]))
    assert sum(r["record_type"] == "revisit" for r in got) >= pages.count()
    assert warc.archive(spark, pages.limit(0)).collect() == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_op13_records(spark, tmp_path, compression):
    """Files follow the format when read byte by byte without Spark, and come back whole, in small splits too."""
    import gzip

    rows = odd_pages()
    path = str(tmp_path / "archive")
    warc.write(spark, spark.createDataFrame(rows, PAGES).repartition(2), path, compression=compression)
    plain = []
    for file in sorted(tmp_path.glob("archive/part-*")):
        data = gzip.decompress(file.read_bytes()) if compression == "gzip" else file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and "Injected" not in fields
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            plain.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), fields.get("WARC-Concurrent-To"), rest[:size]))
            data = rest[size + 4 :]
    assert len(plain) == 3 * len(rows) and len({p[0] for p in plain}) == len(plain)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for part in (keep, "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        got = [(r["record_id"], r["type"], r["target_uri"], *(r["concurrent_to"] or [None]), bytes(r["block"])) for r in warc.records(spark, path).collect()]
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        assert Counter(got) == Counter(plain)


def test_op13_foreign_archive(spark, tmp_path):
    """Other writers' archives: older version, headers in other case and order, links in either direction, several parts, odd bytes, a cut file."""
    import gzip

    def record(version, kind, ident, block, *lines):
        head = "\r\n".join([f"WARC/{version}", f"content-length:   {len(block)}", f"warc-type: {kind}", f"WARC-Record-ID: <{ident}>", *lines])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    binary = bytes(range(256)) * 3
    parts = [
        record("1.0", "warcinfo", "i", b"software: x\r\n"),
        record("1.0", "request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("1.0", "Response", "r1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + binary, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>"),
        record("1.0", "metadata", "m1", b"a: 1\r\n"),
        record("1.1", "metadata", "m2", b"a: 2\r\n", "WARC-Concurrent-To: <r1>"),
        record("1.1", "resource", "s1", binary, "Content-Type: application/octet-stream"),
        record("1.1", "metadata", "m3", b"a: 3\r\n", "WARC-Concurrent-To: <nobody>"),
    ]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "members.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (folder / "cut.warc").write_bytes(record("1.1", "resource", "s2", b"0123456789")[:-9])
    got = {r["record_id"]: r for r in warc.captures(warc.records(spark, str(folder))).collect()}
    assert set(got) == {"<r1>", "<s1>", "<s2>"}
    first = got["<r1>"]
    assert (first["http"], bytes(first["payload"]), first["payload_bytes"]) == ("HTTP/1.1 200 OK\r\nA: b", binary, 768)
    assert [p["record_id"] for p in first["requests"]] == ["<q1>"] and [p["record_id"] for p in first["metadata"]] == ["<m1>", "<m2>"]
    assert bytes(got["<s1>"]["payload"]) == binary and got["<s1>"]["metadata"] == [] and bytes(got["<s2>"]["payload"]) == b"01234"
