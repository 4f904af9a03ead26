"""Op 8: WARC archives, written from pages and read back as transactions.

Writing.  Every page becomes a request, a response or revisit, and a metadata
record, tied by WARC-Concurrent-To.  A record is one string, so Spark's own text
writer stores it on whatever file system the folder is on: its line separator is
the CRLF CRLF that ends a WARC record.  Files hold a bounded number of records
and are gzip-compressed (one member per file; the reader takes files with a
member per record as well); pages of more than 64 KB go to files of their own, by
their largest size, because a file is read as one row.  A payload that repeats is
stored once: of equal payloads of at least ``min_bytes`` bytes the smallest page
id is the response, and the others are revisits that name its record in
WARC-Refers-To.  Record identifiers are made from page id, url and payload, so a
task that runs twice writes the same records.

Reading.  Files come through Spark's binary reader and are cut by Content-Length
(never by searching for a separator, so payloads may hold anything).
``transactions`` joins request, response and metadata through their
concurrent-to identifiers, also where metadata points to the request, and gives
one nested row per capture.

Defined cases: a null payload is empty; a null url is ``urn:page:<id>``, line
ends in urls are percent-encoded; a null page id stays null and is always
a response; rows that repeat the smallest page id of a payload are all
responses; rows that repeat page id, url and payload are one capture stored more
than once, under the same record identifiers; an empty table gives no captures;
a payload may have any length that fits into one row; extra columns are not used.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import scratch, stash

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, kind string, concurrent_to string, refers_to string, target string, digest string, http_head string, fields string, payload_bytes long, payload_digest string, payload binary"
LARGE = 64 << 10


def _lines(*parts) -> Column:
    """Header lines from (name, column) pairs, closed by an empty line."""
    cols = [F.lit("WARC/1.1" + CRLF)]
    for name, value in parts:
        cols += [F.lit(f"{name}: "), value if not isinstance(value, str) else F.lit(value), F.lit(CRLF)]
    return F.concat(*cols, F.lit(CRLF))


def revisits(pages: DataFrame, id_col: str, min_bytes: int) -> DataFrame:
    """The pages with payload, digest, kind and, for revisits, url and record of
    the response.  The right side of the join has only payloads that repeat."""
    firsts = (
        pages.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("target").alias("target"), F.col("rid").alias("rid"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), "first")
    )
    joined = pages.join(firsts, F.col("digest") == F.col("_digest"), "left")
    again = F.coalesce(F.col("first.id") != F.col(id_col), F.lit(False))
    return joined.select(*pages.columns, F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first.target")).alias("refers_target"), F.when(again, F.col("first.rid")).alias("refers_to"))


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 24 << 20) -> None:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    target = F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        target = F.replace(target, F.lit(char), F.lit(code))
    rows = pages.select(
        F.col(id_col), target.alias("target"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest")
    )
    is_large = F.col("bytes") > LARGE
    sizes = rows.agg(F.avg(F.when(~is_large, F.col("bytes"))).alias("mean"), F.avg(F.when(is_large, F.col("bytes"))).alias("large"), F.max("bytes").alias("top")).first()
    rows = rows.select("*", *[_record_id(k, F.col(id_col), F.col("target"), F.col("digest")).alias(c) for c, k in (("rid", "response"), ("qid", "request"), ("mid", "metadata"))])
    rows = revisits(rows, id_col, min_bytes)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    is_revisit = F.col("kind") == "revisit"
    body = F.when(is_revisit, head).otherwise(F.concat(head, F.col("payload")))
    length = F.octet_length(head) + F.when(is_revisit, F.lit(0)).otherwise(F.col("bytes").cast("int"))
    ask = F.concat(F.lit("GET "), F.col("target"), F.lit(f" HTTP/1.1{CRLF}Accept: */*{CRLF}{CRLF}"))
    meta = F.concat(F.lit("page-id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(CRLF))
    size = lambda c: F.octet_length(c).cast("string")
    revisit_lines = F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), F.col("refers_to"), F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.col("refers_target"), F.lit(CRLF))).otherwise(F.lit(""))
    response = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("kind"), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"), revisit_lines,
        F.lit("WARC-Record-ID: "), F.col("rid"), F.lit(f"{CRLF}WARC-Target-URI: "), F.col("target"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF), body,
    )
    request = F.concat(
        _lines(("WARC-Type", "request"), ("WARC-Date", date), ("WARC-Record-ID", F.col("qid")), ("WARC-Concurrent-To", F.col("rid")), ("WARC-Target-URI", F.col("target")), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", size(ask))),
        ask,
    )
    metadata = F.concat(
        _lines(("WARC-Type", "metadata"), ("WARC-Date", date), ("WARC-Record-ID", F.col("mid")), ("WARC-Concurrent-To", F.col("rid")), ("WARC-Target-URI", F.col("target")), ("Content-Type", "application/warc-fields"), ("Content-Length", size(meta))),
        meta,
    )
    end = F.lit(CRLF + CRLF)
    for part, mean, top in ((rows.where(~is_large), sizes["mean"], LARGE), (rows.where(is_large), sizes["large"], sizes["top"])):
        if mean is None and top != LARGE:
            continue  # no large pages
        per_file = int(max(1, min(20_000, file_bytes // ((mean or 0) + 1200), 16 * file_bytes // top)))
        lines = part.select(F.concat(request, end, response, end, metadata).alias("value"))
        lines.write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _unpack(raw: bytes) -> bytes:
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        step = zlib.decompressobj(31)
        out.append(step.decompress(raw))
        raw = step.unused_data
    return b"".join(out)


def _head(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.decode("utf-8", "replace").split(CRLF)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def parse(raw: bytes, payloads: bool) -> Iterator[tuple]:
    """Records of one archive in the order of RECORD_SCHEMA."""
    data, at = _unpack(raw), 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            break
        stop = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        h = _head(data[at:stop])
        a = stop + 4
        b = a + int(h["content-length"])
        if b > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        kind, http, fields, payload, n, sha = h.get("warc-type", ""), None, None, None, None, None
        if kind in ("response", "revisit", "request"):
            cut = data.find(b"\r\n\r\n", a, b)
            cut = b if cut < 0 else cut + 4
            http = data[a:cut].decode("utf-8", "replace")
            if kind == "response":
                payload = data[cut:b]
                n, sha = len(payload), hashlib.sha256(payload).hexdigest()
            elif kind == "revisit":
                n = int(_head(data[a:cut]).get("content-length", 0))
        elif kind == "metadata":
            fields = data[a:b].decode("utf-8", "replace")
        yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, http, fields, n, sha, payload if payloads else None
        at = b


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (RECORD_SCHEMA)."""
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for r in parse(raw.as_py(), payloads):
                    rows.append(r)
                    held += 500 + len(r[10] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, target, refers_to, response, request,
    metadata).  ``records`` is read three times, so it is best a written table.

    Requests hang on the response they name; metadata on the response, or on the
    request, that they name.  Captures without either have nulls there."""
    one = records.where(F.col("kind").isin("response", "revisit"))
    ask = records.where("kind = 'request'").select("record_id", "concurrent_to", "http_head")
    meta = records.where("kind = 'metadata'").select("record_id", "concurrent_to", "fields")
    via = ask.select(F.col("record_id").alias("ask_id"), F.col("concurrent_to").alias("ask_to"))
    meta = meta.join(via, meta.concurrent_to == via.ask_id, "left").select(F.coalesce("ask_to", "concurrent_to").alias("to"), F.struct("record_id", "fields").alias("metadata"))
    asks = ask.groupBy(F.col("concurrent_to").alias("ask_of")).agg(F.min(F.struct("record_id", "http_head")).alias("request"))
    metas = meta.groupBy(F.col("to").alias("meta_of")).agg(F.min("metadata").alias("metadata"))
    return (
        one.join(asks, one.record_id == asks.ask_of, "left")
        .join(metas, one.record_id == metas.meta_of, "left")
        .select("record_id", "target", "refers_to", F.struct("kind", "digest", "http_head", "payload_bytes", "payload_digest", "payload").alias("response"), "request", "metadata")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = stash(read_records(spark, path, payloads=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))
    rows = transactions(records).select(
        "record_id", "refers_to",
        F.nullif(F.regexp_extract("metadata.fields", r"(?m)^page-id: ([^\r\n]*)", 1), F.lit("")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
    )
    rows = stash(rows, "captures")
    named = rows.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("_named")).distinct()
    firsts = rows.join(named, F.col("record_id") == F.col("_named"), "left_semi").groupBy(F.col("record_id").alias("_record")).agg(F.min("page_id").alias("first"))
    return rows.join(firsts, F.col("refers_to") == F.col("_record"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS m FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM f
"""
