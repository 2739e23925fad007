"""Edit-aware token counts: a segment tree over the pre-tokens of a document, kept between edits.

Byte-level BPE never merges across pre-tokens, so a document's count is the sum over them. Leaves
of the tree hold runs of pre-tokens, inner nodes the sums of characters and tokens below them. An
edit finds its place by characters, splits again from a boundary a few characters before it (the
pattern looks at most three characters ahead of a pre-token) until a new boundary behind it falls
on an old one, re-encodes only what lies between, and updates the sums from the touched leaves to
the root. Everything else keeps its counts.

build() makes the state table, a row per document: its text and its tree (lengths and counts of the
pre-tokens, pre-tokens per leaf, sums of the nodes). update() takes a state table with edits and
gives the next one: trees come from their columns, and no text is split or encoded but around the
edits, so what an edit costs in encoding depends on its length, not on the document's. Whoever
keeps counts under edits writes the state and joins edits to it; count() does both steps at once.

Defined results: a null text counts as empty; edits are clipped to the text they meet; null or no
edits leave a document as it is. Rows that repeat each other give one row each. Long texts are
split in blocks of 2 MB; a pre-token of any length is one. Extra columns are ignored by build() and
count() and handed through by nothing. No rows: no rows.
"""

from __future__ import annotations

import base64
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import kernels as K
from corpuloom.llm.common import own
from corpuloom.session import ship

LEAF, CACHE, AHEAD = 64, 400_000, 4
_SAFE = regex.compile(r"(?<=\S) (?=\p{L})")  # a pre-token always begins here
_coders: dict[str, "Pieces"] = {}


class Pieces(dict):
    """Token counts of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        count = len(self.encoding._encode_single_piece(piece))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = count
        return count

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of the pre-tokens; long texts in blocks cut at safe places."""
        lengths, counts, at = [], [], 0
        while at < len(text):
            safe = _SAFE.search(text, at + (1 << 20)) if len(text) - at > 2 << 20 else None
            end = safe.start() if safe else len(text)
            found = self.pattern.findall(text, at, end)
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            counts.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
            at = end
        if not lengths:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(lengths), np.concatenate(counts)


def coder(path: str, pattern: str) -> Pieces:
    if path not in _coders:
        _coders[path] = Pieces(path, pattern)
    return _coders[path]


class Tree:
    """Counts of one document under edits."""

    def __init__(self, text: str, pieces: Pieces):
        self.pieces, self.reencoded = pieces, 0
        self._build(text, *pieces.split(text))

    @classmethod
    def restored(cls, text: str, lengths: bytes, counts: bytes, leaves: bytes, chars: bytes, tokens: bytes, pieces: Pieces) -> "Tree":
        """The tree of which state() gave these."""
        tree = cls.__new__(cls)
        tree.pieces, tree.reencoded = pieces, 0
        sizes = np.frombuffer(leaves, "<i4")
        at = np.cumsum(sizes)[:-1]
        tree.lengths = np.split(np.frombuffer(lengths, "<i4").astype(np.int64), at)
        tree.counts = np.split(np.frombuffer(counts, "<i4").astype(np.int64), at)
        tree.chars, tree.tokens = np.frombuffer(chars, "<i8").copy(), np.frombuffer(tokens, "<i8").copy()
        tree.size = len(tree.chars) // 2
        ends = np.cumsum(tree.chars[tree.size : tree.size + len(sizes)]).tolist()
        tree.texts = [text[a:b] for a, b in zip([0, *ends], ends)]
        return tree

    def state(self) -> tuple:
        """The text, then the tree as little-endian numbers."""
        small = lambda parts: np.concatenate(parts).astype("<i4").tobytes()
        leaves = np.array([len(x) for x in self.lengths], "<i4").tobytes()
        return self.text(), small(self.lengths), small(self.counts), leaves, self.chars.astype("<i8").tobytes(), self.tokens.astype("<i8").tobytes()

    def _build(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> None:
        at = list(range(0, len(lengths), LEAF)) or [0]
        self.lengths = [lengths[i : i + LEAF] for i in at]
        self.counts = [counts[i : i + LEAF] for i in at]
        chars, tokens = (np.add.reduceat(np.append(x, 0), at) for x in (lengths, counts))
        ends = np.cumsum(chars).tolist()
        self.texts = [text[a:b] for a, b in zip([0, *ends], ends)]
        self.size = 1 << max(0, (len(at) - 1).bit_length())
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(at)] = chars
        self.tokens[self.size : self.size + len(at)] = tokens
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one at the end) and the characters before it."""
        node, before = 1, 0
        while node < self.size:
            left = int(self.chars[2 * node])
            node = 2 * node if place - before < left or not self.chars[2 * node + 1] else 2 * node + 1
            before += left if node % 2 else 0
        return min(node - self.size, len(self.texts) - 1), before

    def _set(self, leaf: int) -> None:
        node = leaf + self.size
        self.chars[node], self.tokens[node] = self.lengths[leaf].sum(), self.counts[leaf].sum()
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, delete: int, insert: str) -> None:
        size = int(self.chars[1])
        start = min(max(0, start), size)
        delete = min(max(0, delete), size - start)
        first, before = self._leaf(max(0, start - AHEAD))
        last = self._leaf(max(start, start + delete - 1))[0]
        here = np.cumsum(self.lengths[first])
        # the last boundary that no pre-token before the edit can depend on
        keep = int(np.searchsorted(here, max(0, start - AHEAD) - before, "right"))
        begin = int(here[keep - 1]) if keep else 0
        while True:
            held = range(first, last + 1)
            old = "".join(self.texts[i] for i in held)[begin:]
            lengths = np.concatenate([self.lengths[i] for i in held])[keep:]
            counts = np.concatenate([self.counts[i] for i in held])[keep:]
            at = start - before - begin
            new = old[:at] + insert + old[at + delete :]
            shift = len(insert) - delete
            bounds = {int(b) + shift: i for i, b in enumerate(np.cumsum(lengths).tolist(), 1) if b >= at + delete}
            whole = last == len(self.texts) - 1
            fresh, synced = [], None
            for m in self.pieces.pattern.finditer(new):
                if not whole and m.end() > len(new) - AHEAD:
                    break
                fresh.append(m.group())
                if m.end() >= at + len(insert) and m.end() in bounds:
                    synced = bounds[m.end()]
                    break
            if synced is not None or whole:
                break
            last += 1
        rest = len(lengths) if synced is None else synced
        self.reencoded += len(fresh)
        head = slice(0, keep)
        self.texts[first] = self.texts[first][:begin] + new
        self.lengths[first] = np.concatenate([self.lengths[first][head], np.fromiter(map(len, fresh), np.int64, len(fresh)), lengths[rest:]])
        self.counts[first] = np.concatenate([self.counts[first][head], np.fromiter(map(self.pieces.__getitem__, fresh), np.int64, len(fresh)), counts[rest:]])
        for i in range(first + 1, last + 1):
            self.texts[i], self.lengths[i], self.counts[i] = "", np.empty(0, np.int64), np.empty(0, np.int64)
            self._set(i)
        self._set(first)
        if len(self.lengths[first]) > 16 * LEAF:
            self._build(self.text(), np.concatenate(self.lengths), np.concatenate(self.counts))


STATE = "doc_id long, tokens long, text string, lengths binary, counts binary, leaves binary, chars binary, sums binary"
COUNTS = "n_pretokens long, tokens_before long, n_edits long, tokens_after long, n_reencoded long, n_chars_after long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _built(batches, path: str, pattern: str):
    pieces = coder(path, pattern)
    for batch in K.bounded(batches):
        rows = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), K.texts(batch.column("text"))):
            tree = Tree((raw or b"").decode(), pieces)
            rows.append((doc, tree.total, *tree.state()))
        if rows:
            yield _batch(rows, STATE)


def _updated(batches, path: str, pattern: str, with_state: bool):
    pieces = coder(path, pattern)
    schema = f"{STATE}, {COUNTS}" if with_state else f"doc_id long, {COUNTS}"
    parts = ("text", "lengths", "counts", "leaves", "chars", "sums")
    for batch in K.bounded(batches):
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "edits", *parts)]
        for doc, edits, *state in zip(*columns):
            tree = Tree.restored(*state, pieces)
            before, n = tree.total, sum(map(len, tree.lengths))
            edits = [e for e in edits or [] if e is not None]
            for e in edits:
                tree.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
            kept = (tree.total, *tree.state()) if with_state else ()
            rows.append((doc, *kept, n, before, len(edits), tree.total, tree.reencoded, int(tree.chars[1])))
        if rows:
            yield _batch(rows, schema)


def redactions(text: str = "text") -> Column:
    """A standing edit script: cut a span, add a paragraph break, put a mark over a span, from back to front."""
    n = F.coalesce(F.length(text), F.lit(0))
    kind = "array<struct<start:bigint,delete:bigint,insert:string>>"
    step = lambda part, delete, insert: F.struct(F.floor(n * part / 4).alias("start"), F.lit(delete).alias("delete"), F.lit(insert).alias("insert"))
    return F.array(step(3, 20, ""), step(2, 0, "\n\n"), step(1, 12, " [removed] ")).cast(kind)


def _tokenizer(path: str | None, pattern: str | None) -> dict[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        pattern = pattern or public_tokenizers.PATTERN
    return {"path": path, "pattern": pattern}


def build(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> the state table: doc_id, tokens, text and its tree."""
    ship(spark)
    return own(docs, "doc_id", "text").mapInArrow(partial(_built, **_tokenizer(path, pattern)), STATE)


def update(spark: SparkSession, state: DataFrame, edits: Column | str = "edits", with_state: bool = True, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """A state table and a column of edits in it (start, delete, insert: to apply in order, each placed in the text as it then is) -> the next state and what it took.

    The columns of the state, if asked for, and n_pretokens and tokens_before (before the edits),
    n_edits, tokens_after, n_reencoded (pre-tokens encoded anew) and n_chars_after.
    """
    ship(spark)
    names = [c.split()[0] for c in STATE.split(", ")]
    rows = state.select(*names, (F.col(edits) if isinstance(edits, str) else edits).alias("edits"))
    return rows.mapInArrow(partial(_updated, with_state=with_state, **_tokenizer(path, pattern)), f"{STATE}, {COUNTS}" if with_state else f"doc_id long, {COUNTS}")


def count(spark: SparkSession, docs: DataFrame, edits: Column | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id and what update() tells of the edits."""
    return update(spark, build(spark, docs, path, pattern), edits if edits is not None else redactions(), False, path, pattern)
