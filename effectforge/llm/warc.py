"""WARC archives as a PySpark data source, and the round trip of a page table.

Reading plans one partition for each archive file, takes record-type and header
predicates pushed down by Spark, parses a record's header first and skips the
payload of a record that is not wanted: a plain file is seeked past it, and a
member of a ``.gz`` file is skipped by the length that the ``sl`` field of its
gzip header states (members without that field are inflated and thrown away).
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from effectforge.llm.common import bare, materialize, scratch

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "payload_digest string, refers_to string, payload_length bigint, headers map<string,string>, payload binary"
)
#: WARC header names of the columns that predicates may name.
HEADER_OF = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
}
LENGTH_HEADER = "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"
_BATCH_BYTES = 8 << 20
_CHUNK = 4 << 20


def _clean(value: str) -> str:
    """A header value on one line: line breaks are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record; absent fields are left out, a missing payload is empty."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "resource"
    head = [("WARC-Type", kind)]
    head += [(HEADER_OF[c], row[c]) for c in ("record_id", "target_uri", "refers_to") if row.get(c) is not None]
    head.append(("WARC-Date", row.get("date") or _EPOCH))
    if digest := row.get("payload_digest"):
        head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    length = row.get("payload_length")
    head.append((LENGTH_HEADER, str(len(payload) if length is None else length)))
    if kind == "revisit":
        head.append(("WARC-Profile", REVISIT_PROFILE))
        payload = b""
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        block = http.encode() + payload
        head.append(("Content-Type", "application/http; msgtype=response"))
    else:
        block = payload
        head.append(("Content-Type", row.get("content_type") or "application/octet-stream"))
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


#: Largest length that an ``sl`` field can state.
LONGEST = 0xFFFFFFFF


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member that states its own length and its content's in an ``sl`` field, where both fit its 32 bits."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    if max(total, len(data)) <= LONGEST:
        extra = b"sl" + struct.pack("<HII", 8, total, len(data))
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    records: int


class WarcWriter(DataSourceArrowWriter):
    """One archive file a task; only files in the commit's manifest are ever read."""

    def __init__(self, path: str, compress: bool, level: int) -> None:
        self.path, self.compress, self.level = path, compress, level
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, out, records = f"{self.job}-{uuid.uuid4().hex}.warc" + ".gz" * self.compress, None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row)
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip_member(data, self.level) if self.compress else data)
                records += 1
        if out:
            out.close()
        return _Written(name if out else None, records)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m and m.name)
        with fs.open_output_stream(f"{root}/_manifest-{self.job}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class _Archive(InputPartition):
    path: str


class _Source:
    """Bytes of a file with a short buffer, so that what is skipped is never read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.start, self.buffer = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        inside = offset - self.start
        if not 0 <= inside <= inside + n <= len(self.buffer):
            self.file.seek(offset)
            self.start, self.buffer, inside = offset, self.file.read(max(n, _CHUNK)), 0
        return self.buffer[inside : inside + n]


def _parse_head(head: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip()] = value.strip()
    return fields


def _http_payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _members(source: _Source, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a gzip file, one member each."""
    offset = 0
    while offset < source.size:
        head = source.at(offset, min(24, source.size - offset))
        stated = None
        if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl":
            stated = struct.unpack("<I", head[16:20])[0]
        inflate, at, data = zlib.decompressobj(31), offset, b""
        step = min(stated or _CHUNK, 4096)
        while b"\r\n\r\n" not in data and not inflate.eof:
            piece = source.at(at, min(step, source.size - at))
            if not piece:
                raise ValueError("truncated gzip member")
            data += inflate.decompress(piece)
            at += len(piece)
        top, _, block = data.partition(b"\r\n\r\n")
        fields = _parse_head(top)
        keep = wanted(fields)
        parts = [block] if keep and payloads else None
        if stated and parts is None:
            offset += stated
            if keep:
                yield fields, None
            continue
        while not inflate.eof:
            piece = source.at(at, min(_CHUNK, source.size - at))
            if not piece:
                raise ValueError("truncated gzip member")
            more = inflate.decompress(piece)
            at += len(piece)
            if parts is not None:
                parts.append(more)
        offset = at - len(inflate.unused_data)
        if keep:
            length = int(fields.get("Content-Length", 0))
            yield fields, _http_payload(fields, b"".join(parts)[:length]) if parts is not None else None


def _plain(source: _Source, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an uncompressed file."""
    offset = 0
    while offset < source.size:
        n = 1024
        while (end := (head := source.at(offset, min(n, source.size - offset))).find(b"\r\n\r\n")) < 0:
            if n >= source.size - offset:
                raise ValueError("truncated record")
            n *= 4
        fields = _parse_head(head[:end])
        length = int(fields.get("Content-Length", 0))
        if wanted(fields):
            block = source.at(offset + end + 4, length) if payloads else None
            yield fields, None if block is None else _http_payload(fields, block)
        offset += end + 4 + length + 4


class WarcReader(DataSourceReader):
    """See the module; ``payload=false`` in the options leaves every payload unread."""

    def __init__(self, path: str, payloads: bool) -> None:
        self.path, self.payloads = path, payloads
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((HEADER_OF[column], "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((HEADER_OF[column], "in", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((HEADER_OF[column], "set", ()))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((HEADER_OF[column], "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_Archive(self.path)]
        found = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))]
        manifests = [n for n in found if n.startswith("_manifest-")]
        names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        if manifests:
            listed: set[str] = set()
            for m in manifests:
                with fs.open_input_stream(f"{root}/{m}") as f:
                    listed |= set(json.loads(f.read()))
            names = [n for n in names if n in listed]
        return [_Archive(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)] or [_Archive("")]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for header, test, values in self.tests:
            value = fields.get(header)
            if value is None or test == "in" and value not in values or test == "starts" and not value.startswith(values):
                return False
        return True

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = ["record_id", "record_type", "target_uri", "date", "content_type", "payload_digest", "refers_to"]
        columns: dict[str, list] = {}
        held = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[n], t) for n, t in zip(columns, types, strict=True)], names=list(columns)
            )

        def clear() -> None:
            columns.clear()
            columns.update({n: [] for n in [*names, "payload_length", "headers", "payload"]})

        clear()
        fs, file = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(file) as opened:
            records = _members if file.endswith(".gz") else _plain
            for fields, payload in records(_Source(opened), self._wanted, self.payloads):
                digest = fields.get("WARC-Payload-Digest")
                if digest and digest.startswith("sha1:"):
                    digest = base64.b32decode(digest[5:]).hex()
                for n in names:
                    columns[n].append(digest if n == "payload_digest" else fields.get(HEADER_OF[n]))
                length = fields.get(LENGTH_HEADER)
                columns["payload_length"].append(int(length) if length is not None else payload and len(payload))
                columns["headers"].append(list(fields.items()))
                columns["payload"].append(payload)
                held += len(payload or b"") + 512
                if held >= _BATCH_BYTES:
                    yield batch()
                    clear()
                    held = 0
        if columns["headers"]:
            yield batch()


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``.

    Options: ``payload`` (default true; false leaves payloads unread),
    ``compression`` (``gzip`` by default, or ``none``) and ``level``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self._path(), self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(
            self._path(), self.options.get("compression", "gzip") != "none", int(self.options.get("level", "1"))
        )

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a WARC source needs a path")
        return path if "://" in path else "file://" + path.removeprefix("file:")


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, with predicate pushdown on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """A record for each page, equal payloads of ``min_bytes`` or more as revisits.

    The page with the largest id among those of one payload is the response.
    Ids are of any type that a string can be cast to, and stand in the records' ids
    URL-encoded.  A null page id sorts below all others and gives a record without a
    page in its id; rows that repeat the largest id are responses each; where all ids
    are null all are responses.
    """
    p = bare(pages, "page_id", "url", "html").select(
        "page_id",
        F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    shared = materialize(
        p.filter(F.col("payload_length") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"))
        .filter("n > 1")
        .select("payload_digest", "first_id"),
        "warc-shared",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.url_encode(F.col(c).cast("string")), F.lit(">"))
    return p.join(shared, "payload_digest", "left").select(
        F.coalesce(urn("page_id"), F.lit("<urn:x-page>")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, urn("first_id")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write every page to WARC archives in the shared folder and read them back.

    Sizes and digests of responses are taken from the payloads as read; those
    of revisits are the full payload's, from the record's header.  Page ids come back
    in their own type.  An empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    register(spark)
    path = scratch(spark, "warc")
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)
    kind = bare(pages, "page_id").schema["page_id"].dataType
    page = lambda c: F.url_decode(F.when(F.col(c).startswith("<urn:x-page:"), F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1))).cast(kind)
    full = spark.read.format("warc").option("path", path).load().filter("record_type = 'response'")
    heads = spark.read.format("warc").option("path", path).option("payload", "false").load().filter("record_type = 'revisit'")
    responses = full.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast(kind).alias("refers_to"),
        "target_uri",
    )
    revisits = heads.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        "target_uri",
    )
    return responses.unionByName(revisits)
