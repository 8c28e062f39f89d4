"""Archive scan and sink (S1-S4, S12): WARC/ARC gzip files <-> one row per record.

A Python data source (PySpark 4 ``DataSource``), ``spark.read.format("webarchive")``. A file is read
in byte ranges of ``splitBytes``, one input partition each; a record belongs to the range its gzip
member begins in, so the rows are the same for any number of ranges (``records.py`` finds the first
member of a range, streams inside members and goes on after damage).

Filters on everything but headers and payload are pushed into the reader: a refused record's payload is
passed over there. ``payload="accepted"`` keeps all rows, for counting, but carries only the payloads
of records that the extraction rules can accept. Payloads stay bytes; ``extract_pages`` decodes them.

The sink writes one gzip member per record and rolls files by size. A task writes under a name of its
own; files take their final names when the job commits, so lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as DS
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from archivesearch.sources.records import MAX_ERRORS, MAX_RECORD, RecordReader, Row, Source, http_parts

RECORD_SCHEMA = ("warc_name string, warc_offset long, record_type string, url string, record_date string, "
                 "status string, content_type string, headers map<string,string>, payload binary, error string")
# Only files whose last dot segment is gz (any case) are archives.
ARCHIVE_SUFFIX = ".gz"
SPLIT_BYTES = 128 << 20
FILE_BYTES = 1 << 30
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 1000
_ARROW_SCHEMA = pa.schema([
    ("warc_name", pa.string()), ("warc_offset", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
    ("record_date", pa.string()), ("status", pa.string()), ("content_type", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])
_PLACE = {name: n for n, name in enumerate(_ARROW_SCHEMA.names)}
_PUSHED = set(_PLACE) - {"headers", "payload", "error"}


def is_archive(path: str) -> bool:
    """S2 suffix filter."""
    name = path.rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[-1].lower() == "gz"


def _http_parts(block: bytes):
    """Status, lower-cased headers (first kept) and body of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        head, sep, body = block.partition(b"\n\n")
    parts = http_parts(head)
    return (*parts, body) if parts else (None, {}, block)


# ------------------------------------------------------------------ pushed filters

def _holds(f: DS.Filter, row: Row) -> bool | None:
    """Three-valued result of a filter on a row without its payload."""
    if isinstance(f, DS.Not):
        inner = _holds(f.child, row)
        return None if inner is None else not inner
    value = row[_PLACE[f.attribute[0]]]
    if isinstance(f, DS.IsNull):
        return value is None
    if isinstance(f, DS.IsNotNull):
        return value is not None
    if isinstance(f, DS.EqualNullSafe):
        return value == f.value
    if value is None or getattr(f, "value", "") is None:
        return None
    if isinstance(f, DS.In):
        return True if value in f.value else None if None in f.value else False
    return _TESTS[type(f)](value, f.value)


_TESTS = {DS.EqualTo: lambda a, b: a == b, DS.GreaterThan: lambda a, b: a > b, DS.GreaterThanOrEqual: lambda a, b: a >= b,
          DS.LessThan: lambda a, b: a < b, DS.LessThanOrEqual: lambda a, b: a <= b,
          DS.StringStartsWith: lambda a, b: a.startswith(b), DS.StringEndsWith: lambda a, b: a.endswith(b),
          DS.StringContains: lambda a, b: b in a}
#: Filters that order strings are left to Spark, which compares them by their UTF-8 bytes.
_ORDERED = (DS.GreaterThan, DS.GreaterThanOrEqual, DS.LessThan, DS.LessThanOrEqual)


def _can_push(f: DS.Filter) -> bool:
    if isinstance(f, DS.Not):
        return _can_push(f.child)
    if len(f.attribute) != 1 or f.attribute[0] not in _PUSHED:
        return False
    if isinstance(f, _ORDERED):
        return f.attribute[0] == "warc_offset"
    return type(f) in _TESTS or isinstance(f, (DS.IsNull, DS.IsNotNull, DS.EqualNullSafe, DS.In))


@dataclass(frozen=True)
class Acceptance:
    """The extraction rules as far as a record's head shows them (P1, P3, P4): a record that fails them is never accepted."""

    record_types: tuple = ()
    statuses: tuple = ()
    primary_types: tuple = ()
    excluded_subtypes: tuple = ()

    def __call__(self, row: Row) -> bool:
        kind, status, content_type = row[_PLACE["record_type"]], row[_PLACE["status"]], row[_PLACE["content_type"]]
        if kind is not None and kind not in self.record_types or status is None or content_type is None:
            return False
        if not status.startswith(tuple(self.statuses)):
            return False
        if not self.primary_types:
            return True
        primary, _, rest = content_type.partition("/")
        sub = rest.partition("/")[0].partition(";")[0]
        return primary.lower() in self.primary_types and sub.lower() not in self.excluded_subtypes

    @classmethod
    def of(cls, cfg) -> "Acceptance":
        types = () if cfg.index_all else tuple(cfg.primary_types)
        return cls(tuple(cfg.record_types), (*cfg.status_prefixes, *(("30",) if cfg.index_redirects else ())), types, tuple(cfg.excluded_subtypes))


# ------------------------------------------------------------------ reader

def _filesystem(uri: str):
    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.max_errors = int(options.get("maxErrors", MAX_ERRORS))
        self.max_record = int(options.get("maxRecordBytes", MAX_RECORD))
        self.payload = options.get("payload", "all")
        if self.payload not in ("all", "none", "accepted"):
            raise ValueError("payload must be 'all', 'none' or 'accepted'")
        rules = json.loads(options.get("acceptance", "{}"))
        self.acceptance = Acceptance(**{k: tuple(v) for k, v in rules.items()})
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs
        filesystem, root = _filesystem(self.path)
        info = filesystem.get_file_info(root)
        found = [info]
        if info.type == pafs.FileType.Directory:
            found = [f for f in filesystem.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if not is_archive(f.path):
                continue
            uri, size = with_authority(f.path, self.path), f.size or 0
            starts = range(0, max(1, size), self.split_bytes)
            out += [InputPartition((uri, a, None if a + self.split_bytes >= size else a + self.split_bytes)) for a in starts]
        return out

    def rows(self, uri: str, start: int = 0, stop: int | None = None) -> Iterator[Row]:
        keeps = None
        if self.filters:
            keeps = lambda row: all(_holds(f, row) for f in self.filters)
        with_payload = {"all": None, "none": lambda row: False, "accepted": self.acceptance}[self.payload]
        reader = RecordReader(uri.rsplit("/", 1)[-1], keeps, with_payload, self.max_record, self.max_errors)
        failfast = self.mode == "FAILFAST"
        try:
            filesystem, path = _filesystem(uri)
            with filesystem.open_input_file(path) as file:
                for row in reader.read(Source(file, file.size()), start, stop):
                    if failfast and row[-1]:
                        raise ValueError(f"{uri}: {row[-1]}")
                    yield row
        except Exception as e:  # S4: a file that cannot be read, a missing one too, is one error
            if failfast:
                raise
            row = reader.error(None, f"{type(e).__name__}: {e}")
            if keeps is None or keeps(row):
                yield row

    def read(self, partition):
        yield from _batches(self.rows(*partition.value))


def _batches(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[8] or b"")
        if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[Row]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[_PLACE["headers"]] = [list(h.items()) for h in columns[_PLACE["headers"]]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_SCHEMA)], schema=_ARROW_SCHEMA)


def with_authority(path: str, root: str) -> str:
    """The URI of a listed path: scheme and host of the root it was found under."""
    if "://" not in root or "://" in path:
        return path
    scheme, rest = root.split("://", 1)
    host = rest.split("/", 1)[0]
    if path == host or path.startswith(f"{host}/"):  # stores that list bucket/key
        return f"{scheme}://{path}"
    return f"{scheme}://{host}{path if path.startswith('/') else '/' + path}"


# ------------------------------------------------------------------ sink

@dataclass
class _Written(WriterCommitMessage):
    names: tuple


class ArchiveWriter(DataSourceWriter):
    """Rows of ``RECORD_SCHEMA`` (what is absent is null) -> WARC files below ``path``. A column ``raw``, where it is not null, is a
    finished member that is written as it is (to copy or to rearrange archives)."""

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], [f.name for f in schema.fields], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.members = options.get("members", "record")
        if self.members not in ("record", "file"):
            raise ValueError("members must be 'record' or 'file'")
        self.job = uuid.uuid4().hex

    def block(self, row) -> bytes:
        get = lambda name: row[name] if name in self.columns else None
        kind, url, payload = get("record_type") or "response", get("url"), bytes(get("payload") or b"")
        body = payload
        if kind in ("response", "revisit") and (url or "").lower().startswith("http"):
            headers = dict(get("headers") or {})
            if get("content_type") is not None:
                headers.setdefault("content-type", get("content_type"))
            lines = [f"HTTP/1.1 {get('status') or 200} -", *(f"{k}: {v}" for k, v in headers.items())]
            body = "\r\n".join([*lines, "", ""]).encode("utf-8") + payload
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
        lines += [f"{name}: {value}" for name, value in (("WARC-Date", get("record_date")), ("WARC-Target-URI", url)) if value is not None]
        lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
        return "\r\n".join(lines).encode("utf-8") + body + b"\r\n\r\n"

    def write(self, iterator):
        filesystem, root = _filesystem(self.path)
        filesystem.create_dir(root, recursive=True)
        task, names, out, written = uuid.uuid4().hex, [], None, 0
        member = None
        for row in iterator:
            if out is None:
                names.append(f"{self.job[:8]}-{task[:12]}-{len(names):05d}.warc.gz")
                out, written = filesystem.open_output_stream(f"{root}/_{names[-1]}.part", compression=None), 0
                member = gzip.GzipFile(fileobj=out, mode="wb") if self.members == "file" else None
            raw = row["raw"] if "raw" in self.columns else None
            data = bytes(raw) if raw is not None else self.block(row)
            if member:
                member.write(data)
            else:
                data = data if raw is not None else gzip.compress(data, 6)
                out.write(data)
            written += len(data)
            if written >= self.file_bytes:
                if member:
                    member.close()
                out.close()
                out = None
        if out is not None:
            if member:
                member.close()
            out.close()
        return _Written(tuple(names))

    def commit(self, messages):
        filesystem, root = _filesystem(self.path)
        filesystem.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow import fs as pafs
            for f in filesystem.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and is_archive(f.path):
                    filesystem.delete_file(f.path)
        for name in (n for m in messages if m for n in m.names):
            filesystem.move(f"{root}/_{name}.part", f"{root}/{name}")

    def abort(self, messages):
        filesystem, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            filesystem.delete_file(f"{root}/_{name}.part")


class ArchiveDataSource(DataSource):
    """``spark.read.format("webarchive").load(path)`` and ``df.write.format("webarchive").save(path)``."""

    @classmethod
    def name(cls):
        return "webarchive"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, schema, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveDataSource)
    return spark


def read_archive(spark: SparkSession, path: str, mode: str = "PERMISSIVE", accepted=None, **options) -> DataFrame:
    """Records of every ``*.gz`` archive under ``path`` (recursive). With ``accepted`` (an ``ExtractConfig``) only
    payloads that its rules can accept are carried. Further options: ``splitBytes``, ``maxErrors``, ``maxRecordBytes``, ``payload``."""
    reader = _registered(spark).read.format("webarchive").option("mode", mode).options(**options)
    if accepted is not None:
        reader = reader.option("payload", "accepted").option("acceptance", json.dumps(vars(Acceptance.of(accepted))))
    return reader.load(path)


def write_archive(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Records (columns of ``RECORD_SCHEMA``) as WARC files. Options: ``fileBytes``, ``members`` (one for each record, or one
    for the file)."""
    _registered(records.sparkSession)
    records.write.format("webarchive").mode(mode).options(**options).save(path)


def read_archive_list(spark: SparkSession, list_path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """S3: a text file of archive locations (one per line, blanks skipped) -> records."""
    locations = (spark.read.text(list_path).select(F.trim("value").alias("path")).filter("path <> ''"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArchiveReader({"path": "", "mode": mode})
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(reader.rows(path))

    return locations.repartition(n, "path").mapInArrow(records, RECORD_SCHEMA)
