"""WARC archives as a PySpark data source, and an archive writer that stores equal payloads once.

``spark.read.format("warc")`` plans one partition per archive (small ones packed together), takes
record-type and header predicates, parses each record's headers first and goes past a payload that
is not asked for without decoding it.  A payload is decoded only if the read schema has ``payload``,
and checked against its digest only with option ``verify``.  Archives are per-record gzip members
whose header holds the member's length (extra field ``SL``), so going past one is a seek; archives of
other writers, plain or gzip, are read as well.

Predicates: an ordinary filter on ``record_type`` is pushed down, as are ``.option("record_type",
"response,revisit")`` and ``.option("header.<Name>", value)``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, digest_hex string, payload_length long, refers_to string, payload binary"
#: The profile that WARC 1.1 names for revisits of an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 128 << 20
FILE_BYTES = 512 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _clean(value: str) -> str:
    """A header value in one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its own and the data's length in an extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = 4 + 16
    total = 10 + 2 + extra + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQQ", extra, b"SL", 16, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(record_id: str, kind: str, uri: str | None, digest_hex: str, length: int, refers_to: str | None, payload: bytes | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip()] = value.strip()
    return out


class _Members:
    """Records of one archive: headers first, then the block if it is asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        at = 0
        while at < self.size:
            self.file.seek(at)
            head = self.file.read(32)
            if head[:2] != b"\x1f\x8b":
                at = yield from self._plain(at)
            elif len(head) == 32 and head[3] == 4 and head[12:14] == b"SL":
                total, _ = struct.unpack("<QQ", head[16:32])
                yield self._sized(at + 32, at + total - 8)
                at += total
            else:
                at = yield from self._streamed(at)

    def _sized(self, start: int, end: int):
        z, seen, raw = zlib.decompressobj(-15), b"", b""
        self.file.seek(start)
        while (cut := seen.find(b"\r\n\r\n")) < 0:
            fresh = raw or self.file.read(min(2048, end - self.file.tell()))
            if not fresh:
                raise ValueError("a WARC record ends within its headers")
            seen += z.decompress(fresh, 4096)
            raw = z.unconsumed_tail
        headers, at = _headers(seen[:cut]), self.file.tell()

        def block() -> bytes:
            self.file.seek(at)
            rest = z.decompress(raw + self.file.read(end - at)) + z.flush()
            return (seen + rest)[cut + 4 : cut + 4 + int(headers["Content-Length"])]

        return headers, block

    def _plain(self, at: int):
        self.file.seek(at)
        seen = b""
        while (cut := seen.find(b"\r\n\r\n")) < 0:
            fresh = self.file.read(2048)
            if not fresh:
                if seen.strip():
                    raise ValueError("a WARC record ends within its headers")
                return self.size
            seen = (seen + fresh).lstrip(b"\r\n") if not seen.strip() else seen + fresh
        headers = _headers(seen[:cut])
        start, length = self.file.tell() - len(seen) + cut + 4, int(headers["Content-Length"])

        def block() -> bytes:
            self.file.seek(start)
            return self.file.read(length)

        yield headers, block
        return start + length + 4

    def _streamed(self, at: int):
        """A member of unknown length has to be inflated to find its end."""
        self.file.seek(at)
        z, data = zlib.decompressobj(31), io.BytesIO()
        while not z.eof:
            fresh = self.file.read(1 << 16)
            if not fresh:
                break
            data.write(z.decompress(fresh))
        whole = data.getvalue()
        inner = _Members(io.BytesIO(whole), len(whole))
        yield from inner
        return self.file.tell() - len(z.unused_data)


@dataclass
class Archives(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = schema.names
        self.path = options["path"]
        self.kinds = {k.strip() for k in options["record_type"].split(",")} if options.get("record_type") else None
        self.wanted = {k[len("header."):].lower(): v for k, v in options.items() if k.lower().startswith("header.")}
        self.verify = options.get("verify", "false").lower() == "true"

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and tuple(f.attribute) == ("record_type",):
                self.kinds = set(values) if self.kinds is None else self.kinds & set(values)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root):])
        parts, room = [], 0
        for path, size in files:
            if size > room or not parts:
                parts.append(Archives([]))
                room = PARTITION_BYTES
            parts[-1].files.append((path, size))
            room -= size
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        rows: list[tuple] = []
        held = 0
        for path, size in partition.files:
            with fs.open_input_file(path) as file:
                for headers, block in _Members(file, size):
                    kind = headers.get("WARC-Type", "")
                    if self.kinds is not None and kind not in self.kinds:
                        continue
                    if self.wanted and any({k.lower(): v for k, v in headers.items()}.get(k) != v for k, v in self.wanted.items()):
                        continue
                    rows.append(self._row(headers, kind, block))
                    held += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    def _row(self, headers: dict[str, str], kind: str, block) -> tuple:
        digest = headers.get("WARC-Payload-Digest", "").rpartition(":")[2] or None
        bare = lambda name: _unclean(headers[name].strip("<>")) if name in headers else None
        payload = None
        if kind != "revisit" and ("payload" in self.columns or self.verify):
            data = block()
            payload = data.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else data
            if self.verify and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {headers.get('WARC-Record-ID')} does not match its digest")
        length = headers.get("X-Payload-Length")
        values = {
            "record_id": bare("WARC-Record-ID"), "record_type": kind, "target_uri": bare("WARC-Target-URI"), "payload_digest": digest,
            "payload_length": int(length) if length is not None else len(payload) if payload is not None else None,
            "refers_to": bare("WARC-Refers-To"), "headers": list(headers.items()), "payload": payload,
        }
        return tuple(values[c] for c in self.columns)


_ARROW = {
    "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(),
    "payload_length": pa.int64(), "refers_to": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(),
}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write below ``_pending``; only the commit moves their archives to where readers look."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.level = options["path"], int(options.get("level", "1"))
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/{self.pending}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{self.pending}/{files[-1]}", compression=None), 0
                data = member(record_bytes(row["record_id"], row["record_type"], row["target_uri"], row["digest_hex"], row["payload_length"], row["refers_to"], row["payload"]), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for name in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/{self.pending}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.pending}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.pending}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known; Spark takes filters to a Python source only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, id_col: str, uri_col: str, payload: Column, min_bytes: int = 0) -> DataFrame:
    """Archive records of ``pages``: of equal payloads of at least ``min_bytes``, the largest id is the response.

    Only digests are grouped.  A null payload is empty.  Rows that repeat the largest id are all
    responses; null ids count as smallest, and a payload that only null ids have is all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("record_id"), F.col(id_col).alias("__id"), F.col(uri_col).cast("string").alias("target_uri"), F.coalesce(payload, F.lit(b"")).alias("payload")
    ).withColumns({"digest_hex": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    largest = rows.groupBy("digest_hex", "payload_length").agg(F.max("__id").alias("__largest"))
    response = F.col("__id").eqNullSafe(F.col("__largest")) | (F.col("payload_length") < min_bytes)
    joined = rows.join(largest, ["digest_hex", "payload_length"])
    return joined.select(
        F.concat(F.lit("urn:page:"), F.coalesce("record_id", F.lit(""))).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        "digest_hex",
        "payload_length",
        F.when(~response, F.concat(F.lit("urn:page:"), F.col("__largest").cast("string"))).alias("refers_to"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)
