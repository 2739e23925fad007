"""WARC archives: writing captures, reading records, and putting transactions together.

write(): a page makes three records, a response (or a revisit of the response with the same payload),
the request that asked for it, and metadata that name the page; request and metadata point to the
response by WARC-Concurrent-To. records(): a row per record of any WARC file that Spark can read,
plain or gzip. captures(): the records of one transaction in one nested row, joined through their
concurrent-to identifiers in either direction.

Spark's own text files hold the archives, with the mark between two records as line separator, so
that no file or record passes through Python and plain archives are read in parts. Content lengths
are checked: where a payload itself holds such a mark, the pieces of that file are put together
again by their places and lengths.

Defined results: a null page has an empty payload; payloads are bytes, whatever they hold. Of pages
of the same payload (``least`` bytes or more) the one with the smallest page_id (null last) is the
response; of rows that tie in page_id, one. A null url leaves out the target's header. Requests
and metadata that name no capture of the archive belong to none and are left out of captures().
Extra columns are ignored. No rows: no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import own
from corpuloom.session import Scratch

LINE, BLANK = "\r\n", "\r\n\r\n"
#: What stands between two records: the end of one and the beginning of the next, up to the minor version.
MARK = "\r\n\r\nWARC/1."
DATE = "2020-01-01T00:00:00Z"
CAPTURES = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32: four times ten hexadecimal digits make eight letters each."""
    text = F.upper(F.sha1(data))
    part = lambda i: F.lpad(F.upper(F.conv(F.substring(text, 1 + 10 * i, 10), 16, 32)), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    """A record's identifier from what it is made of."""
    text = F.md5(F.concat_ws("\x01", *parts))
    cuts = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header's line; nothing where the value is null. Breaks within a value are written as percent codes."""
    value = F.lit(value) if isinstance(value, str) else F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _record(kind: Column | str, ident: Column, block: Column, *lines: Column) -> Column:
    """A record without the blank lines that end it."""
    head = [_line("WARC-Type", kind), _line("WARC-Record-ID", ident), _line("WARC-Date", DATE), *lines, _line("Content-Length", F.octet_length(block))]
    return F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit(LINE), block)


def write(spark: SparkSession, pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Archives of pages (page_id, url, html) in a folder. Payloads of fewer than ``least`` bytes are all responses."""
    rows = own(pages, "page_id", "url", "html").select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # rows are told apart by number, so they are written before they are numbered a second time
    staged = f"{Scratch(spark, 'warc').root}/pages"
    rows.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    one = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "_row", "url")
    first = rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min(one).alias("_first"))
    rows = rows.join(first, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= least), "left")
    again = F.col("_first").isNotNull() & (F.col("_first._row") != F.col("_row"))
    number, origin = F.col("_row").cast("string"), F.col("_first._row").cast("string")
    ident = _uuid(F.lit("capture"), number, F.col("digest"))
    target = _line("WARC-Target-URI", F.col("url"))
    concurrent = _line("WARC-Concurrent-To", ident)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BLANK)
    )
    capture = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), ident, F.when(again, http).otherwise(F.concat(http, F.col("payload"))),
        target, _line("Content-Type", "application/http;msgtype=response"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(
            _line("WARC-Refers-To", _uuid(F.lit("capture"), origin, F.col("digest"))), _line("WARC-Refers-To-Target-URI", F.col("_first.url")),
            _line("WARC-Refers-To-Date", DATE), _line("WARC-Profile", PROFILE),
        )).otherwise(F.lit("")),
    )
    host = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(BLANK))
    request = _record("request", _uuid(F.lit("request"), number, F.col("digest")), asked, target, _line("Content-Type", "application/http;msgtype=request"), concurrent)
    fields = F.concat(_line("page-id", F.col("page_id")), _line("payload-bytes", F.col("bytes")))
    metadata = _record("metadata", _uuid(F.lit("metadata"), number, F.col("digest")), fields, target, _line("Content-Type", "application/warc-fields"), concurrent)
    rows.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", BLANK).option("compression", compression).text(path)


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _head(text: Column) -> Column:
    return F.substring_index(text, BLANK, 1)


def header(head: Column, name: str) -> Column:
    """The first value of a header, null where there is none. Names are in either case."""
    value = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", F.rtrim(value))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two marks, with the bytes that its header asks for and that it has beyond what it needs (negative: cut short)."""
    raw = spark.read.option("lineSep", MARK).text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.withColumn("_place", F.monotonically_increasing_id())
    raw = raw.withColumn("_head", _head(F.col("value")))
    asked = header(F.col("_head"), "Content-Length").try_cast("long")
    return raw.withColumn("_over", F.coalesce(_length(F.col("value")) - _length(F.col("_head")) - 4 - asked, F.lit(0).cast("long")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: record_id, type, target_uri, date, concurrent_to (a list), refers_to, payload_digest, content_type, block (bytes).

    A record that the file cuts short has the bytes that are there.
    """
    pieces = _pieces(spark, path)
    torn = pieces.where(F.col("_over") < 0).select(F.col("_file").alias("_torn")).distinct()
    whole = pieces
    if not torn.isEmpty():
        whole = pieces.join(torn, F.col("_file") == F.col("_torn"), "left_anti").select("value").unionByName(_glued(spark, pieces.join(torn, F.col("_file") == F.col("_torn"), "left_semi")))
    head = _head(F.col("value"))
    block = F.substring(F.col("value").cast("binary"), (_length(head) + 5).cast("int"), F.coalesce(header(head, "Content-Length").try_cast("int"), F.lit(0)))
    return whole.select(
        header(head, "WARC-Record-ID").alias("record_id"), F.lower(header(head, "WARC-Type")).alias("type"), header(head, "WARC-Target-URI").alias("target_uri"),
        header(head, "WARC-Date").alias("date"), F.regexp_extract_all(head, F.lit(r"(?i)\r\nWARC-Concurrent-To:[ \t]*([^\r\n]*[^\r\n \t])")).alias("concurrent_to"),
        header(head, "WARC-Refers-To").alias("refers_to"), header(head, "WARC-Payload-Digest").alias("payload_digest"), header(head, "Content-Type").alias("content_type"),
        block.alias("block"),
    ).where(F.col("type").isNotNull())


def _owners(frame):
    """For each piece of a file, in order, the place of the piece whose record it belongs to."""
    frame = frame.sort_values(["_block", "_place"], kind="stable")
    owners, owner, missing = [], None, 0
    for place, size, over in zip(frame["_place"].tolist(), frame["_size"].tolist(), frame["_over"].tolist()):
        if missing > 0:
            missing -= size + len(MARK)
        else:
            owner, missing = place, -over
        owners.append(owner)
    return frame[["_file", "_block", "_place"]].assign(_owner=owners)


def _glued(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """The records of files in which some payload holds the mark: a piece cut short takes the following ones until it has its bytes.

    Only places and lengths of a file's pieces meet in one task, and then the pieces of one record.
    """
    pieces = Scratch(spark, "warc").table(pieces.select("_file", "_block", "_place", "value", "_over"), "torn")
    narrow = pieces.select("_file", "_block", "_place", _length(F.col("value")).alias("_size"), "_over")
    owners = narrow.groupBy("_file").applyInPandas(_owners, "_file string, _block long, _place long, _owner long")
    owners = owners.select(F.col("_place").alias("_p"), F.col("_block").alias("_b"), "_owner")
    parts = pieces.join(owners, F.col("_place") == F.col("_p")).groupBy("_owner").agg(F.sort_array(F.collect_list(F.struct("_b", "_p", "value"))).alias("_parts"))
    return parts.select(F.array_join(F.transform("_parts", lambda x: x["value"]), MARK).alias("value"))


def _payload(block: Column) -> Column:
    """What follows the header of an HTTP message."""
    return F.substring(block, (_length(_head(block.cast("string"))) + 5).cast("int"), F.octet_length(block))


def measured(records: DataFrame) -> DataFrame:
    """Records with what their blocks hold: http (head of the message), payload, its payload_bytes and payload_sha1 (in base32)."""
    http = F.coalesce(F.startswith(F.col("content_type"), F.lit("application/http")), F.lit(False))
    payload = F.when(http, _payload(F.col("block"))).otherwise(F.col("block"))
    return records.select(
        "*", F.when(http, _head(F.col("block").cast("string"))).alias("http"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_sha1"),
    )


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its record_id, type, target_uri, date, refers_to, payload_digest (as stated), http (head of the
    message), payload, its payload_bytes and payload_sha1 (as read, in base32), and lists of its request and metadata records.

    A capture is a response, revisit or resource record. A part belongs to it when one of the two names the other in
    WARC-Concurrent-To. What is measured of a payload is measured before the join, so payloads move only where they are asked for.
    ``records`` may be measured already.
    """
    if "payload_sha1" not in records.columns:
        records = measured(records)
    found = records.where(F.col("type").isin(*CAPTURES)).select(
        "record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "http", "payload", "payload_bytes", "payload_sha1", "concurrent_to"
    )
    parts = records.where(F.col("type").isin("request", "metadata")).select(F.struct("record_id", "type", "target_uri", "date", "content_type", "block").alias("part"), "concurrent_to")
    # names under which a part may know its capture: the capture's own, and the part's own where the capture names it
    known = found.select(F.col("record_id").alias("_capture"), F.explode(F.array_distinct(F.concat(F.array("record_id"), "concurrent_to"))).alias("_name"))
    named = parts.select("part", F.explode(F.array_distinct(F.concat(F.array(F.col("part.record_id")), "concurrent_to"))).alias("_called"))
    linked = (
        named.join(known, F.col("_called") == F.col("_name"))
        .groupBy("_capture")
        .agg(F.sort_array(F.collect_set("part")).alias("_parts"))
    )
    of = lambda kind: F.filter(F.coalesce("_parts", F.array().cast(linked.schema["_parts"].dataType)), lambda p: p["type"] == kind)
    found = found.drop("concurrent_to")
    return found.join(linked, F.col("record_id") == F.col("_capture"), "left").select(*found.columns, of("request").alias("requests"), of("metadata").alias("metadata"))


def field(block: Column, name: str) -> Column:
    """A field of an application/warc-fields block."""
    return header(block.cast("string"), name)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Pages written as archives (to a scratch folder unless ``path`` names one), read back and put together: a row per page.

    page_id (from the metadata record), payload_bytes and payload_digest (of the payload that was read, a revisit's being its
    response's), record_type, refers_to (the response's page_id), n_requests and target_uri.
    """
    path = path or f"{Scratch(spark, 'warc').root}/archive"
    write(spark, pages, path, least)
    # read once: captures without their bytes, and the other records
    read = measured(records(spark, path)).withColumns({"payload": F.lit(None).cast("binary"), "block": F.when(~F.col("type").isin(*CAPTURES), F.col("block"))})
    held = captures(Scratch(spark, "warc").table(read, "records")).select(
        "record_id", "type", "refers_to", "target_uri", "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        field(F.get("metadata", F.lit(0))["block"], "page-id").cast("long").alias("page_id"), F.size("requests").alias("n_requests"),
    )
    held = Scratch(spark, "warc").table(held, "captures")
    origin = held.where(F.col("type") == "response").select(*[F.col(c).alias(f"_{c}") for c in ("record_id", "page_id", "payload_bytes", "payload_digest")])
    again = F.col("type") == "revisit"
    pick = lambda c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return held.join(origin, again & (F.col("refers_to") == F.col("_record_id")), "left").select(
        "page_id", pick("payload_bytes"), pick("payload_digest"), F.col("type").alias("record_type"), F.when(again, F.col("_page_id")).alias("refers_to"), "n_requests", "target_uri"
    )
