"""Text to tokens and n-grams, as column expressions.

A token is a run without white space or punctuation, or a run of sentence punctuation. Normalizing
drops all but ASCII letters, digits and the underscore, lower-cases, and turns numbers into NUM;
punctuation becomes the empty token, which n-grams may not cross.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[^\x20\x09-\x0D.,;:!?]+|[.,;:!?]+"
DROP = r"[^A-Za-z0-9_]+"
NUMBER = r"^[0-9]+$"


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition (Catalyst has none); a no-op for text already in that form."""
    for text in texts:
        yield text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def normalize(token: Column) -> Column:
    bare = F.lower(F.regexp_replace(token, DROP, ""))
    return F.regexp_replace(bare, NUMBER, "NUM")  # a condition on bare would compute it twice


def normalized(text: Column) -> Column:
    return F.transform(tokenize(text), normalize)


def is_legit(token: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Neither empty nor a stop word, and 1 < length < 20."""
    return (F.length(token) > 1) & (F.length(token) < 20) & ~token.isin(*stopwords or ("",))


def is_boundary(token: Column) -> Column:
    return token == ""


def ngrams(tokens: Column, n: int = 2, stopwords: tuple[str, ...] = (), mode: str = "any") -> Column:
    """1- to n-grams joined by '-'. Unigrams are legitimate tokens; longer ones don't cross a
    boundary and need any (or ``all``) of their parts legitimate; only parts are tested for length."""
    if mode not in ("any", "all"):
        raise ValueError("mode must be any or all")
    parts = [F.filter(tokens, lambda t: is_legit(t, stopwords))]
    test = F.exists if mode == "any" else F.forall
    for k in range(2, n + 1):
        def gram(i: Column) -> Column:
            words = F.slice(tokens, i, k)  # noqa: B023  used at once
            legit = test(words, lambda t: is_legit(t, stopwords)) & ~F.array_contains(words, "")
            return F.when(legit, F.array_join(words, "-"))

        starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.array_compact(F.transform(starts, gram)))
    return F.concat(*parts)


def stopword_proportion(tokens: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Tokens that aren't legitimate over all tokens; null for a text without tokens."""
    legit = F.size(F.filter(tokens, lambda t: is_legit(t, stopwords)))
    return F.when(F.size(tokens) > 0, (F.size(tokens) - legit) / F.size(tokens))


def ends_with_punctuation(text: Column) -> Column:
    return ~text.rlike("[A-Za-z0-9]$")


def count_overlapping(text: Column, pattern: str) -> Column:
    """Occurrences of a substring, overlapping ones included: those positions where a lookahead matches."""
    literal = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in pattern)
    if not pattern:
        return F.lit(0)
    return F.regexp_count(text, F.lit(f"(?={literal})"))


def clean_html(text: Column) -> Column:
    """Drop comments, trim what stays; null if nothing does."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?s)<!--.*?-->", "")), F.lit(""))


def clean_video(text: Column) -> Column:
    """Cut an embedded player's script from its opening mark to its length in minutes; null if nothing stays."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?s)// <!\[CDATA\[.*?Length::.*?Mins", "")), F.lit(""))


def json_string(json: Column, key: str) -> Column:
    """The value under a key, the word NULL where it is missing."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit("NULL"))


def format_array(values: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit(")"))


def clamp_rating(value: Column) -> Column:
    """Ratings as text to 1..5; -1 where there is none."""
    number = value.try_cast("double").cast("int")
    return F.when(value.isNull() | (value == "None") | number.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), number)))


# The same over whole texts, in Arrow batches: as bytes every part of a character outside ASCII is one that normalizing drops.

_BLANK, _MARKS = b" \t\n\v\f\r", b".,;:!?"
_KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
#: Bytes in lower case; '-' stands for those that are dropped, a full stop for punctuation, a blank for white space.
_FORM = bytes(ord(chr(b).lower()) if b in _KEPT else 32 if b in _BLANK else 46 if b in _MARKS else 45 for b in range(256))
_FORM_BLANK = _FORM.replace(b".", b" ")
_RUNS = re.compile(rb"\.+|[^ .]+")


class _Normalized(dict):
    """Raw tokens in that form to normalized ones, each distinct one worked out once."""

    def __missing__(self, raw: bytes) -> str:
        if len(self) > 1_000_000:
            self.clear()
        bare = raw.replace(b"-", b"")
        self[raw] = token = "NUM" if bare.isdigit() else "" if bare[:1] == b"." else bare.decode()
        return token


class _Legit(dict):
    """Tokens to whether they are legitimate."""

    def __init__(self, stopwords: frozenset[str]):
        self.stopwords = stopwords

    def __missing__(self, token: str) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = good = 1 < len(token) < 20 and token not in self.stopwords
        return good


def _add_grams(out: dict[str, int], tokens: list[str], n: int, legit: _Legit, every: bool) -> None:
    """Adds counts of one sequence of tokens' 2- to n-grams, joined; distinct ones are tested once. No token holds the joint."""
    for k in range(2, n + 1):
        for words, tf in Counter(zip(*[tokens[i:] for i in range(k)])).items():
            if "" in words:
                continue
            good = [legit[w] for w in words]
            if all(good) if every else any(good):
                out["-".join(words)] = tf


def _counts_of(text: bytes, n: int, normal: _Normalized, legit: _Legit, every: bool) -> dict[str, int]:
    out: dict[str, int] = {}
    for raw, tf in Counter(text.translate(_FORM_BLANK).split()).items():
        token = normal[raw]
        if legit[token]:
            out[token] = out.get(token, 0) + tf
    if n > 1:
        _add_grams(out, [normal[raw] for raw in _RUNS.findall(text.translate(_FORM))], n, legit, every)
    return out


def _sentences_of(text: bytes, normal: _Normalized, legit: _Legit) -> dict[tuple[int, str], int]:
    out: dict[tuple[int, str], int] = {}
    stn = 0
    for raw in _RUNS.findall(text.translate(_FORM)):
        token = normal[raw]
        if not token:
            stn += 1
        elif legit[token]:
            at = stn, token
            out[at] = out.get(at, 0) + 1
    return out


def counted(batches: Iterator[pa.RecordBatch], n: int, stopwords: tuple[str, ...], mode: str, sentences: bool) -> Iterator[pa.RecordBatch]:
    """(key, text) in order of the keys -> key, sentence, term, tf, len (the key's sum of tf): legitimate 1- to n-grams of each key's texts.

    What tokenize(), normalize() and ngrams() say, counted text by text. Sentences (0 throughout unless asked for, unigrams only)
    are numbered by the empty tokens before.
    """
    normal, legit, every = _Normalized(), _Legit(frozenset(stopwords)), mode == "all"
    keys, stns, terms, tfs, lens = [], [], [], [], []

    def add(key, counts: dict) -> None:
        keys.extend([key] * len(counts))
        if sentences:
            stns.extend([stn for stn, _ in counts])
            terms.extend([term for _, term in counts])
        else:
            terms.extend(counts)
        tfs.extend(counts.values())
        lens.extend([sum(counts.values())] * len(counts))

    def batch() -> pa.RecordBatch:
        at = pa.array(stns if sentences else np.zeros(len(keys), np.int64), pa.int64())
        columns = [pa.array(keys, pa.int64()), at, pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())]
        out = pa.RecordBatch.from_arrays(columns, ["key", "stn", "term", "tf", "len"])
        for x in (keys, stns, terms, tfs, lens):
            x.clear()
        return out

    last, held = None, None
    for part in batches:
        for key, text in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
            now = _sentences_of(text or b"", normal, legit) if sentences else _counts_of(text or b"", n, normal, legit, every)
            if held is not None and key == last:
                for term, tf in now.items():
                    held[term] = held.get(term, 0) + tf
                continue
            if held:
                add(last, held)
            last, held = key, now
            if len(keys) > 100_000:
                yield batch()
    if held:
        add(last, held)
    if keys:
        yield batch()
