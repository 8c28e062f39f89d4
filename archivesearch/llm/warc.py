"""WARC transactions: write captures as archives, read archives, join their records to captures.

Writing: every page becomes a response (or revisit), a request and a metadata record, the last
two pointing to the first by WARC-Concurrent-To. A record ends with two line breaks, which are
the line separator of Spark's text writer, so archives are written by Spark to any store (gzip).
Of pages with equal payloads of at least ``min_bytes`` the one with the smallest page_id is the
response, the others revisit it. Reading: archives are parsed record by record while they are
decompressed. Assembling: requests, metadata and other records are joined to the response,
revisit or resource record that their concurrent-to identifiers name, directly, backwards (the
response names them) or through one other record, and each capture is one nested row.

Defined results: null html is an empty payload; a null page_id or url is absent in the records
and null when read; line breaks, spaces and control characters in a url are percent-encoded. Rows that repeat
a page_id are captures of their own; of equal ones with one page_id the first read is the
response. Records that no response answers for are captures without a response. A response
record that occurs twice makes two captures, each with the members. The members of
a capture that has over ``MAX_MEMBERS`` are dealt to several rows, told apart by ``part``. A damaged archive ends at its damage and
its last record has type ``error``; the records before it count. No pages give no archive records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, shared_path, stored

MIN_BYTES = 100
MAX_MEMBERS = 1000
HEADS = ("response", "revisit", "resource")
_END = "\r\n\r\n"
_RECORD = ("file string, at long, type string, record_id string, concurrent_to array<string>, target_uri string, "
           "date string, refers_to string, declared_digest string, http_status int, http_length long, "
           "payload_bytes long, payload_digest string, payload binary")


def _lines(*pairs):
    """Header lines; those with a null value are left out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in pairs])


def _uuid(*parts):
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = MIN_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as gzip WARC 1.1 files under ``path``."""
    rows = pages.select(
        col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"),
        F.regexp_replace(col("url"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    # Smallest page_id of each payload that occurs twice; rows without an id come last.
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    copies = (rows.filter(F.col("n") >= min_bytes).groupBy("digest")
              .agg(F.count("*").alias("copies"), F.min(first).alias("first")).filter("copies > 1")
              .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    rows = rows.join(copies, "digest", "left")
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    name = lambda kind, page, row: _uuid(F.lit(kind), page.cast("string"), row.cast("string"))
    own = name("response", F.col("page_id"), F.col("row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(_END))

    def record(kind, record_id, block, mime, *more):
        head = _lines(("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)),
                      ("WARC-Target-URI", F.col("url")), *more, ("Content-Type", F.lit(mime)),
                      ("Content-Length", F.octet_length(block).cast("string")))
        return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit(_END), block)

    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    about = ("WARC-Concurrent-To", own)
    main = F.when(revisit, record(
        F.lit("revisit"), own, http, "application/http;msgtype=response", digest,
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", name("response", F.col("first_id"), F.col("first_row"))))).otherwise(record(
            F.lit("response"), own, F.concat(http, F.col("html")), "application/http;msgtype=response", digest))
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", r"^[^/]*//[^/]*(/.*)$", 1), F.lit("")), F.lit("/")),
                     F.lit(" HTTP/1.1\r\nHost: "),
                     F.coalesce(F.regexp_extract("url", r"^[^/]*//([^/]*)", 1), F.lit("")), F.lit(_END))
    fields = F.concat(_lines(("page-id", F.col("page_id").cast("string")), ("payload-bytes", F.col("n").cast("string"))), F.lit("\r\n"))
    records = F.array(
        main, record(F.lit("request"), name("request", F.col("page_id"), F.col("row")), asked,
                     "application/http;msgtype=request", about),
        record(F.lit("metadata"), name("metadata", F.col("page_id"), F.col("row")), fields,
               "application/warc-fields", about))
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", 60_000).text(path))


class _Stream:
    """Bytes of a plain or gzip (also many-member) file, decompressed as they are asked for."""

    STEP = 1 << 16

    def __init__(self, content):
        self.content, self.at, self.buffer, self.offset = content, 0, bytearray(), 0
        self.gzip = bytes(content[:2]) == b"\x1f\x8b"
        self.expand = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if self.gzip and self.expand.unconsumed_tail:
            self.buffer += self.expand.decompress(self.expand.unconsumed_tail, 16 * self.STEP)
            return True
        if self.gzip and self.expand.eof:
            self.at -= len(self.expand.unused_data)
            if self.at >= len(self.content):
                return False
            self.expand = zlib.decompressobj(31)
        part = bytes(self.content[self.at:self.at + self.STEP])
        if not part:
            if self.gzip and not self.expand.eof:
                raise ValueError("the archive ends within its compression")
            return False
        self.at += len(part)
        self.buffer += self.expand.decompress(part, 16 * self.STEP) if self.gzip else part
        return True

    def until(self, mark: bytes) -> bytes | None:
        searched = 0
        while (found := self.buffer.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.buffer)
            if not self._more():
                return None
        return self.take(found + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self._more():
            pass
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        self.offset += len(out)
        return out


def _headers(block: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


def parse(content) -> Iterator[dict]:
    """The records of one archive in their order."""
    stream, last = _Stream(content), 0
    try:
        while True:
            while stream.buffer[:2] == b"\r\n" or (not stream.buffer and stream._more()):
                if stream.buffer[:2] == b"\r\n":
                    stream.take(2)
            last = stream.offset
            if not stream.buffer:
                return
            head = stream.until(b"\r\n\r\n")
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError("no record starts here")
            pairs = _headers(head)
            first = dict(reversed(pairs))
            size = int(first["content-length"])
            block = stream.take(size)
            if len(block) < size:
                raise ValueError("the record is cut off")
            record = {"at": last, "type": first.get("warc-type"), "record_id": first.get("warc-record-id"),
                      "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"],
                      "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
                      "refers_to": first.get("warc-refers-to"), "declared_digest": first.get("warc-payload-digest"),
                      "http_status": None, "http_length": None, "payload": block}
            if first.get("content-type", "").startswith("application/http") and record["type"] in HEADS:
                http, _, body = block.partition(b"\r\n\r\n")
                answer = dict(reversed(_headers(http)))
                status = http.split(b"\r\n", 1)[0].split(b" ")
                length = answer.get("content-length", "")
                record |= {"http_status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None,
                           "http_length": int(length) if length.isdigit() else None, "payload": body}
            record |= {"payload_bytes": len(record["payload"]), "payload_digest": hashlib.sha256(record["payload"]).hexdigest()}
            yield record
    except (ValueError, KeyError, zlib.error) as e:
        yield {"at": last, "type": "error", "payload": str(e).encode()}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; see ``_RECORD`` for the columns. Size and
    SHA-256 are those of the payload as read; without ``payloads`` the payloads of responses
    themselves are left behind in the task."""
    names = [part.split()[0] for part in _RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(),
             pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, size = [], 0
                for record in parse(memoryview(content.as_buffer())):
                    if not payloads and record["type"] in HEADS:
                        record["payload"] = None
                    found.append(record | {"file": file})
                    size += len(record["payload"] or b"")
                    if size >= 8 << 20 or len(found) >= 5000:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, _RECORD)


def assemble(records: DataFrame, max_members: int = MAX_MEMBERS) -> DataFrame:
    """One nested row per capture: record_id, part, response (struct), requests and others (arrays).
    The records are stored first, so that archives are parsed once for all the joins."""
    records = stored(records.filter("type <> 'error' and record_id is not null"), shared_path(records.sparkSession, "records"))
    is_head = F.col("type").isin(*HEADS)
    heads, members = records.filter(is_head), records.filter(~is_head)
    head_ids = heads.select(F.col("record_id").alias("head")).distinct()
    forward = members.select("record_id", F.explode("concurrent_to").alias("to"))
    backward = heads.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("head"))
    direct = forward.join(head_ids, forward["to"] == F.col("head")).select("record_id", "head").unionByName(backward)
    through = (forward.join(direct.select(F.col("record_id").alias("to"), "head"), "to").select("record_id", "head"))
    # A member that names several captures belongs to the smallest; links found directly go first.
    of = (direct.withColumn("hops", F.lit(1)).unionByName(through.withColumn("hops", F.lit(2)))
          .groupBy("record_id").agg(F.min(F.struct("hops", "head")).alias("h"))
          .select("record_id", F.col("h.head").alias("head")))
    small = members.select("record_id", "type", "target_uri", "date", F.col("payload").alias("block"))
    placed = small.join(of, "record_id", "left").withColumn("head", F.coalesce("head", "record_id"))
    crowded = (placed.groupBy("head").agg(F.count("*").alias("n")).filter(F.col("n") > max_members))
    placed = (placed.join(crowded, "head", "left")
              .withColumn("part", F.coalesce(F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n") / max_members)),
                                             F.lit(0)).cast("int")))
    one = F.struct("record_id", "type", "target_uri", "date", "block")
    groups = placed.groupBy("head", "part").agg(F.sort_array(F.collect_set(one)).alias("members"))
    joined = (heads.withColumn("_own", F.col("record_id")).join(groups, F.col("_own") == groups["head"], "full_outer"))
    pick = lambda kind, same: F.filter("members", lambda m: (m["type"] == kind) == F.lit(same))
    return joined.select(
        F.coalesce("record_id", "head").alias("record_id"), F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.col("_own").isNotNull(), F.struct(
            "type", "target_uri", "date", "http_status", "http_length", "declared_digest", "refers_to", "payload",
            F.when(F.col("type") != "revisit", F.col("payload_bytes")).alias("payload_bytes"),
            F.when(F.col("type") != "revisit", F.col("payload_digest")).alias("payload_digest"))).alias("response"),
        pick("request", True).alias("requests"), pick("request", False).alias("others"))


def digest(captures: DataFrame) -> DataFrame:
    """Per capture of archives that ``write_archives`` wrote: page_id and what was stored of it."""
    field = lambda name: F.regexp_extract(
        F.col("others")[0]["block"].cast("string"), rf"(?:^|\n){name}: ([0-9-]+)\r", 1)
    rows = captures.select(
        "record_id", F.nullif(field("page-id"), F.lit("")).cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"),
        F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
        F.coalesce("response.payload_digest", F.regexp_replace("response.declared_digest", "^sha256:", "")).alias("payload_digest"))
    ids = rows.filter("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"))
    return rows.join(ids, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
