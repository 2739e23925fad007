"""Secret scans: multipart credential linking, in DataFrame operations only.

Strong spans (assignments of long secrets, access identifiers, long hex runs) are always
reported. Weak candidates (short secrets, short access identifiers, user names, endpoints) are
reported only with the complementary parts that lie within ``scope`` code points of them in the
same document without overlapping them: a weak secret needs an identifier, a weak identifier needs
a secret, an endpoint needs both. No string plays two parts at once. The interval join is a sweep
over the ends of spans: a span's start knows the last end before it of each role, its end the next
start behind it, and the nearer of the two is its partner (the one before it if both are as near).
No pairs are made, so a document with very many spans costs n log n.

Defined results: a null text counts as empty (no spans). Rows that repeat each other give one
result row each. A null doc_id stays null. Of spans that end (or begin) at the same place, the
later start (or the earlier end) is the partner, then the kind listed last (or first). Long texts
are scanned whole; their spans are rows, so none of them limits their number. Extra columns are
ignored. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.llm.common import own

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)" + _VALUE
USER = r"(?i)(user_?name|user|login|account|client_id|access_key_id)" + _VALUE
ENDPOINT = r"""(?i)(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs of 16 and more, as [0-9a-f]+ has them

#: kinds in the order in which spans of the same start are listed: name, role, strong
KINDS = (
    ("assign", "secret", True),
    ("access", "identifier", True),
    ("hex", "secret", True),
    ("weak_assign", "secret", False),
    ("weak_access", "identifier", False),
    ("user", "identifier", False),
    ("endpoint", "endpoint", False),
)
_HIT = "array<struct<family:int,i:int,gap:int,len:int,value:int>>"
_PARTNERS = "array<struct<kind:string,start:int,end:int>>"


def _hits(text: Column, family: int, pattern: str, value: Column | None = None) -> Column:
    """Lengths of each match and of the gap before it; offsets are their running sums."""
    gaps = F.split(text, pattern, -1)

    def hit(match: Column, i: Column) -> Column:
        size = F.length(match) if value is None else F.length(F.regexp_extract(match, pattern, 2))
        return F.struct(
            F.lit(family).alias("family"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"),
            F.length(match).alias("len"), size.alias("value"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit).cast(_HIT)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_HIT))


def spans(docs: DataFrame, scope: int = 200, shortest_secret: int = 6, shortest_user: int = 3) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, rank, end, kind, partners), of which strong spans have no partners."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.array(F.struct(*[F.lit(-1).alias(n) for n in ("family", "i", "gap", "len", "value")])).cast(_HIT)
    group2 = F.lit(2)
    hits = F.concat(
        mark,
        _hits(text, 0, ASSIGN, group2),
        _hits(text, 1, ACCESS),
        _hits(text, 2, HEX),
        _hits(text, 3, USER, group2),
        _hits(text, 4, ENDPOINT),
    )
    # Rows that repeat each other (a null doc_id with the same text, say) become one before the shuffle.
    key = ["doc_id", "_text"]
    rows = (
        own(docs, "doc_id", "text")
        .select("doc_id", F.xxhash64(text, F.length(text)).alias("_text"), hits.alias("_hits"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_copies"), F.first("_hits").alias("_hits"))
        .select(*key, "_copies", F.inline("_hits"))
    )
    order = Window.partitionBy(*key, "family").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    family, value = F.col("family"), F.col("value")
    rank = (
        F.when(family == 0, F.when(value >= 12, 0).when(value >= shortest_secret, 3))
        .when(family == 1, F.when(value >= 18, 1).when(value >= 8, 4))
        .when(family == 2, 2)
        .when((family == 3) & (value >= shortest_user), 5)
        .when(family == 4, 6)
    )
    placed = (
        rows.withColumn("end", end.cast("int"))
        .withColumn("start", F.col("end") - F.col("len"))
        .withColumn("rank", rank)
        .where(F.col("rank").isNotNull() | (family == -1))
    )
    roles = {r: [k for k, (_, role, _) in enumerate(KINDS) if role == r] for r in ("secret", "identifier", "endpoint")}
    # Two events a span: at its start it looks back and is found from behind, at its end the other way round.
    name = [F.col("start"), F.col("rank"), F.col("end")]
    events = placed.select(
        *key, "_copies", "family", *name,
        F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(0).alias("opens")))).alias("event"),
    ).select(*key, "_copies", "family", *name, "event.*")
    # Of the events of one place ends come first, so spans that touch are disjoint.
    before = Window.partitionBy(*key).orderBy("at", "opens", "start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("opens"), F.desc("start"), F.desc("end"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)

    def partner(role: str) -> Column:
        """What this event sees of a role: the nearest span on its side, with the gap to it."""
        part = F.col("rank").isin(roles[role])
        left = F.max(F.when(part & (F.col("opens") == 0), F.struct("end", "start", "rank"))).over(before)
        right = F.min(F.when(part & (F.col("opens") == 1), F.struct("start", "end", "rank"))).over(after)
        found = lambda span, gap, side: F.when(gap <= scope, F.struct(gap.alias("gap"), F.lit(side).alias("side"), *[span[n].alias(n) for n in ("start", "end", "rank")]))
        return F.when(F.col("opens") == 1, found(left, F.col("start") - left["end"], 0)).otherwise(found(right, right["start"] - F.col("end"), 1))

    swept = (
        events.withColumn("_secret", partner("secret")).withColumn("_identifier", partner("identifier"))
        .groupBy(*key, "_copies", "family", *name).agg(F.min("_secret").alias("_secret"), F.min("_identifier").alias("_identifier"))
    )
    needs = F.when(F.col("rank") == 3, F.array("_identifier")).when(F.col("rank").isin(4, 5), F.array("_secret")).when(F.col("rank") == 6, F.array("_secret", "_identifier"))
    kind = lambda rank: F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), rank + 1)
    partners = F.transform(needs, lambda p: F.struct(kind(p["rank"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    span = F.when(
        (F.col("family") >= 0) & ((F.col("rank") < 3) | F.forall(needs, lambda p: p.isNotNull())),
        F.struct("start", "rank", "end", kind(F.col("rank")).alias("kind"), F.coalesce(partners, F.array().cast(_PARTNERS)).alias("partners")),
    )
    return (
        swept.select(*key, "_copies", span.alias("span"))
        .groupBy(*key, "_copies")
        .agg(F.array_sort(F.collect_list("span")).alias("spans"))
        .select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
        .drop("_copy")
    )


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def linked(spans: Column) -> Column:
    """Each weak span and what completes it."""
    weak = F.filter(spans, lambda s: s["rank"] >= 3)
    return F.array_join(F.transform(weak, lambda s: F.concat(F.concat_ws(":", s["kind"], s["start"], s["end"]), F.lit(">"), F.array_join(F.transform(s["partners"], lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), "+"))), ",")


def scan(docs: DataFrame, **options) -> DataFrame:
    """Counts, the digest of the strong spans, all spans and the weak ones with their partners, a row per document."""
    found = spans(docs, **options)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] >= 3)).cast("long").alias("n_linked"),
        linked(F.col("spans")).alias("links"),
    )
