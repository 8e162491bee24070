"""WARC archives: writing captures, reading records back, and assembling transactions.

`write_archive` stores each page as three records (a request, a response or a revisit of an equal payload, and a
metadata record) tied by WARC-Concurrent-To. `read_records` parses archives. `assemble` joins the records of each
capture through those identifiers and emits one nested row per capture.

Archives are written by Spark's text writer (gzip files, records ended by CRLF CRLF), so its commit protocol, its
retries and every file system it knows apply. Files are bounded, for the reader takes one file at a time.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup

#: Payloads from this size on are stored once; later equal ones are revisits.
DEDUPE_FROM = 1000
#: Bytes of payload in one archive file, about; pages larger than BIG go to files of their own, of at most MOST_BYTES.
FILE_BYTES, BIG, MOST_BYTES = 24 << 20, 1 << 20, 1 << 29
ANCHORS = ("response", "revisit", "resource")
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target string, date string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def _urn(kind: str, *columns: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[c.cast("string") for c in columns]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, date: str, target: Column, content_type: Column | str, block: Column, *extra: tuple[str, Column]) -> Column:
    """A WARC record without its closing CRLF CRLF. Headers whose value is null are left out."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    fields = [("WARC-Type", text(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target), *extra, ("Content-Type", text(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in fields]
    return F.concat(F.lit("WARC/1.0\r\n"), *lines, F.lit("\r\n"), block)


def write_archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `pages` as WARC files under `path` (a job runs).

    Null html is an empty payload; a null id or url leaves out its header. Of equal payloads of DEDUPE_FROM bytes
    or more, the row with the largest id is the response (one of them, if rows repeat). `pages` must be the same
    when it is read again, as a scan of files is. Other columns are not stored. No rows give no records.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.col(url), r"[\r\n]", "%0A"), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(id).alias("_id"), uri.alias("_url"), body.alias("_body"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_bytes", F.octet_length("_body").cast("long")).withColumn("_sha", F.sha1(F.col("_body").cast("binary")))
    rows = rows.withColumn("_key", F.when(F.col("_bytes") >= DEDUPE_FROM, F.col("_sha")))
    groups = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_row")).alias("_of")).where("_n > 1")
    size = rows.agg(F.avg("_bytes").alias("mean"), F.max("_bytes").alias("most")).first()
    rows = lookup(rows, groups, "_key", "_n", F.col("_row"))

    capture = _urn("capture", F.col("_row"), F.col("_id"))
    revisit = F.col("_of").isNotNull() & (F.col("_of._row") != F.col("_row"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    request = F.concat(F.lit("GET "), F.coalesce(F.col("_url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    facts = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: archive\r\n"))
    http = lambda msg: f"application/http; msgtype={msg}"
    records = F.array(
        _record("request", _urn("request", F.col("_row"), F.col("_id")), date, F.col("_url"), http("request"), request, ("WARC-Concurrent-To", capture)),
        _record(
            F.when(revisit, "revisit").otherwise("response"), capture, date, F.col("_url"), http("response"), F.when(revisit, head).otherwise(F.concat(head, F.col("_body"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha"))),
            ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("_of._row"), F.col("_of._id")))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        _record("metadata", _urn("metadata", F.col("_row"), F.col("_id")), date, F.col("_url"), "application/warc-fields", facts, ("WARC-Concurrent-To", capture)),
    )
    mean, most = size["mean"] or 0, size["most"] or 0
    parts = [(rows, FILE_BYTES / (mean + 500))]
    if most > BIG:
        parts = [(rows.where(F.col("_bytes") <= BIG), min(FILE_BYTES / (mean + 500), MOST_BYTES / BIG)), (rows.where(F.col("_bytes") > BIG), MOST_BYTES / most)]
    for k, (part, pages_a_file) in enumerate(parts):
        writer = part.select(F.explode(records).alias("value")).write.mode("append" if k else "errorifexists")
        writer.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 3 * max(1, int(pages_a_file))).option("compression", "gzip").text(path)


def _parse(data: bytes, payloads: bool) -> Iterator[tuple]:
    at, size = 0, len(data)
    while at < size:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            head[name.lower()] = value
        start, stop = end + 4, end + 4 + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut short")
        kind, fields, digest, count, payload = head.get("warc-type"), None, None, None, None
        if kind == "response":
            body = data[data.index(b"\r\n\r\n", start, stop) + 4 : stop]
            digest, count, payload = hashlib.sha1(body).hexdigest(), len(body), body if payloads else None
            if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                raise ValueError(f"the payload of {head.get('warc-record-id')} has another digest than its header says")
        elif kind == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        elif head.get("content-type") == "application/warc-fields":
            fields = dict(x.split(": ", 1) for x in data[start:stop].decode("utf-8", "replace").split("\r\n") if ": " in x)
        yield head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, count, payload, fields
        at = stop + 4


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`, one row each (columns of RECORD).

    Digest and size of responses come from their payload, which must agree with its header; a malformed archive
    fails. With `payloads` false the payload column is null and never leaves the parser.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data, rows, held = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, [], 0
                for row in _parse(data, payloads):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: `capture_id`, `response` (struct; of a response, revisit or resource record), `requests` and `metadata` (arrays of structs).

    A record belongs to the capture that its WARC-Concurrent-To names, directly or through one more record; a
    response may itself name its request. Records that lead to no response form captures whose `response` is null.
    """
    anchor = F.col("type").isin(*ANCHORS)
    named = records.where(F.col("concurrent_to").isNotNull()).select("record_id", "concurrent_to", anchor.alias("a"))
    links = named.select(F.when(F.col("a"), F.col("concurrent_to")).otherwise(F.col("record_id")).alias("child"), F.when(F.col("a"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("parent"))
    links = links.groupBy("child").agg(F.min("parent").alias("parent"))
    next_ = links.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
    roots = links.join(next_, "parent", "left").select(F.col("child").alias("record_id"), F.coalesce("grand", "parent").alias("root"))
    owned = records.join(roots, "record_id", "left").withColumn("capture_id", F.when(anchor, F.col("record_id")).otherwise(F.coalesce("root", "record_id")))
    response = F.struct("type", "target", "date", "digest", "payload_bytes", "payload", "refers_to")
    return owned.groupBy("capture_id").agg(
        F.first(F.when(anchor, response), ignorenulls=True).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target", "date")))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )


def captures(assembled: DataFrame) -> DataFrame:
    """One row per capture with the payload's size and digest in full: a revisit takes them from the response it refers to.

    Columns: capture_id, page_id, target, record_type, payload_bytes, payload_digest, refers_to (the id of the page
    that a revisit refers to), n_requests. A revisit whose response is missing keeps its digest; its size and refers_to are null.
    """
    flat = assembled.where(F.col("response").isNotNull()).select(
        "capture_id",
        F.get("metadata", F.lit(0))["fields"]["page_id"].try_cast("long").alias("page_id"),
        F.col("response.target").alias("target"),
        F.col("response.type").alias("record_type"),
        F.col("response.payload_bytes").alias("bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.refers_to").alias("of"),
        F.size("requests").alias("n_requests"),
    )
    asked = flat.where(F.col("of").isNotNull()).groupBy("of").agg(F.count("*").alias("n"))
    given = asked.join(flat.select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full")), "of")
    out = lookup(flat, given, "of", "n", F.col("capture_id"))
    return out.select("capture_id", "page_id", "target", "record_type", F.coalesce("bytes", "full").alias("payload_bytes"), "payload_digest", "refers_to", "n_requests")


def remove(spark: SparkSession, path: str) -> None:
    """Delete `path` on whatever file system it is."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
