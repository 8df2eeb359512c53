"""Operator 13, WARC archives as a Spark data source, read sequentially.

``df.write.format("warc").save(folder)`` writes records, each a gzip member of its own, to files of at most about a gigabyte.
Files have unique names in a folder of the write; the committing driver lists those of the tasks that counted in a
manifest, so files of lost or repeated attempts are never read. ``spark.read.format("warc").load(folder or file)`` deals out whole files;
a task inflates a file a megabyte at a time, frames records by their content length, separates the HTTP head, and checks
block and payload digests as the bytes pass. With ``payload`` false no payload is kept and memory doesn't grow with it.

Options. Writing: ``level`` (6), ``file_bytes`` (1 GB), ``date``. Reading: ``payload`` (true), ``strict`` (true: a damaged record ends the
job with file and offset; false: it is returned with its ``problem``, and where the framing is lost the rest of that file
is skipped). Reads archives of others too: plain or gzipped files, several records in a member, chunked HTTP bodies, any record
type, records without HTTP; digests in base 32 or hexadecimal.

``archive`` writes pages: of equal payloads (SHA-256) of at least ``least`` bytes one is a response and the others revisit it. Copies are
counted map-side; where repeated payloads are few, Spark broadcasts them and no page moves, else the one row per repeated
payload is dealt to 16 salts, so a payload of a third of all pages spreads.

Defined results: null html is an empty payload; among rows of the same id and payload one, chosen freely, is the response and the rest
revisit it; a null id is the smallest; null or odd urls are kept (line ends and controls percent-encoded); an empty table writes
no records and reads as none; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .common import saved, shared_dir, table

CHUNK = 1 << 20
HEAD_LIMIT = 8 << 20
LEAST = 1000
SALTS = 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
WRITTEN = ["record_type", "record_id", "target_uri", "refers_to", "refers_to_uri", "payload", "payload_bytes", "payload_digest"]
RECORD = (
    "file string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, refers_to_uri string, content_type string, "
    "http_status int, block_bytes long, payload_bytes long, payload_digest string, payload binary, fields map<string,string>, problem string"
)


# files


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a path or address."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _listed(fs: pafs.FileSystem, at: str) -> list[pafs.FileInfo]:
    return [i for i in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)) if i.is_file]


def _manifests(files: list[pafs.FileInfo]) -> list[pafs.FileInfo]:
    return [i for i in files if i.base_name.startswith("_manifest-")]


def archive_files(path: str) -> list[tuple[str, int]]:
    """Files to read and their sizes: those of the manifests; every .warc and .warc.gz where there is none; the path itself if a file."""
    fs, at = file_system(path)
    own = fs.get_file_info(at)
    if own.is_file:
        return [(at, own.size)]
    if own.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = _listed(fs, at)
    wanted = [i for i in files if i.base_name.endswith((".warc", ".warc.gz"))]
    if manifests := _manifests(files):
        names = set()
        for m in manifests:
            with fs.open_input_stream(m.path) as f:
                names |= {posixpath.join(at, n) for n in json.loads(f.read())}
        wanted = [i for i in wanted if i.path in names]
        if len(wanted) < len(names):
            raise FileNotFoundError(f"{path}: {len(names) - len(wanted)} files of the manifest are missing")
    return sorted((i.path, i.size) for i in wanted)


# writing


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(row: dict, date: str) -> bytes:
    """A record's bytes: WARC head, block, and the two line ends after it."""
    kept = row["record_type"] != "revisit"
    payload = (row["payload"] or b"") if kept else b""
    size = len(payload) if kept else row["payload_bytes"]
    digest = hashlib.sha1(payload).digest() if kept else bytes.fromhex(row["payload_digest"])
    block = HTTP_HEAD.format(size).encode() + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", _line(row["target_uri"])))
    if not kept:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["refers_to"])]
        if row["refers_to_uri"] is not None:
            head.append(("WARC-Refers-To-Target-URI", _line(row["refers_to_uri"])))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceArrowWriter):
    """Tasks write files of unique names; only the commit makes them part of the archive."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.file_bytes = int(options.get("level", 6)), int(options.get("file_bytes", 1 << 30))
        self.date = options.get("date", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        self.folder = f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = file_system(self.path)
        fs.create_dir(posixpath.join(at, self.folder), recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(name) for name in WRITTEN]
                for i in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out:
                            out.close()
                        files.append(f"{self.folder}/{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(posixpath.join(at, files[-1]), compression=None), 0
                    data = member(record({n: c[i].as_py() for n, c in zip(WRITTEN, columns, strict=True)}, self.date), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        old = _manifests(_listed(fs, at)) if self.overwrite else []
        told = json.dumps(sorted(f for m in messages if m for f in m.files)).encode()
        with fs.open_output_stream(posixpath.join(at, f"_manifest-{self.folder}.json"), compression=None) as f:
            f.write(told)
        for m in old:
            fs.delete_file(m.path)

    def abort(self, messages) -> None:
        fs, at = file_system(self.path)
        if fs.get_file_info(posixpath.join(at, self.folder)).type != pafs.FileType.NotFound:
            fs.delete_dir(posixpath.join(at, self.folder))


# reading


class Damage(Exception):
    """A record that can't be framed."""


class Bytes:
    """A file's bytes, inflated member by member and never more than is asked for and a chunk."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed = raw, packed
        self.buffer, self.pending, self.inflate = bytearray(), b"", None
        self.seen = self.member = self.passed = 0

    def _more(self) -> bool:
        while True:
            data = self.pending
            if not data:
                data = self.raw.read(CHUNK)
                self.seen += len(data)
            if not data:
                if self.inflate:
                    raise Damage("the file ends inside a gzip member")
                return False
            if not self.packed:
                self.buffer += data
                return True
            if self.inflate is None:
                self.member, self.inflate = self.seen - len(data), zlib.decompressobj(31)
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise Damage(f"gzip: {e}") from None
            if self.inflate.eof:
                self.pending, self.inflate = self.inflate.unused_data, None
            else:
                self.pending = self.inflate.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def start(self) -> int | None:
        """Skips line ends between records; the offset of the next record (of its member, if gzipped), or None at the end."""
        while True:
            while self.buffer[:1] in (b"\r", b"\n"):
                del self.buffer[:1]
                self.passed += 1
            if self.buffer:
                return self.member if self.packed else self.passed
            if not self._more():
                return None

    def take(self, n: int) -> bytes:
        """Up to n bytes; none at the end."""
        if not self.buffer and n and not self._more():
            return b""
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.passed += len(out)
        return out

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if len(self.buffer) > HEAD_LIMIT or not self._more():
                raise Damage("a head without end")
        return self.take(found + len(mark))


def fields_of(lines: bytes) -> dict[str, str]:
    """Named fields, names in lower case; continued lines joined; the first of repeated names counts."""
    out: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last is not None:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            if last in out:
                last = None
            else:
                out[last] = value.strip()
    return out


def digest_of(field: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest field; None where there is none or its algorithm is unknown."""
    name, _, value = (field or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        return name, bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.strip().upper() + "=" * (-len(value.strip()) % 8))
    except (ValueError, binascii.Error):
        return name, b""


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


class Block:
    """A block as it passes: its digest, the HTTP head, and the payload's length, digest and, if kept, bytes."""

    def __init__(self, http: bool, keep: bool, wanted: set[str]):
        self.http, self.keep, self.parts, self.size = http, keep, [], 0
        self.all = {n: hashlib.new(n) for n in wanted}
        self.payload = {n: hashlib.new(n) for n in wanted}
        self.head: bytes | None = None if http else b""
        self.waiting, self.fields, self.status, self.chunked = b"", {}, None, False

    def add(self, data: bytes) -> None:
        for h in self.all.values():
            h.update(data)
        if self.head is None:
            self.waiting += data
            cut = self.waiting.find(b"\r\n\r\n")
            if cut < 0:
                return
            self._begin(self.waiting[: cut + 4])
            data, self.waiting = self.waiting[cut + 4 :], b""
        self._body(data)

    def _begin(self, head: bytes) -> None:
        self.head, self.fields = head, fields_of(head.partition(b"\n")[2])
        status = re.match(rb"HTTP/\S+ +(\d{3})", head)
        self.status = int(status[1]) if status else None
        self.chunked = "chunked" in self.fields.get("transfer-encoding", "").lower()

    def _body(self, data: bytes) -> None:
        if self.keep or self.chunked:
            self.parts.append(data)
        if not self.chunked:
            self.size += len(data)
            for h in self.payload.values():
                h.update(data)

    def end(self) -> bytes | None:
        if self.head is None:  # all of it is head
            self._begin(self.waiting)
        body = b"".join(self.parts)
        if self.chunked:
            body = dechunked(body)
            self.size = len(body)
            for h in self.payload.values():
                h.update(body)
        return body if self.keep else None


def records(raw, packed: bool, keep: bool = True) -> Iterator[dict]:
    """The records of an open file. After a record that can't be framed there is one with only offset and problem, and no more."""
    source, offset = Bytes(raw, packed), 0
    try:
        while (at := source.start()) is not None:
            offset = at
            first = source.until(b"\n")
            if not re.match(rb"WARC/\d", first):
                raise Damage("no WARC version line")
            lines = []
            while (line := source.until(b"\n")).strip():
                lines.append(line)
            fields = fields_of(b"".join(lines))
            if not re.fullmatch(r"\d+", fields.get("content-length", "")):
                raise Damage("no content length")
            length, kind = int(fields["content-length"]), fields.get("warc-type", "")
            http = fields.get("content-type", "").lower().startswith("application/http")
            told = {n: digest_of(fields.get(f"warc-{n}-digest")) for n in ("block", "payload")}
            block, left = Block(http, keep, {"sha1"} | {d[0] for d in told.values() if d}), length
            while left:
                data = source.take(min(left, CHUNK))
                if not data:
                    raise Damage("the file ends inside a block")
                block.add(data)
                left -= len(data)
            payload = block.end()
            problem = None
            tail = b""
            while len(tail) < 4 and (data := source.take(4 - len(tail))):
                tail += data
            if tail != b"\r\n\r\n":
                raise Damage("no end after the block: its length is wrong")
            if told["block"] and block.all[told["block"][0]].digest() != told["block"][1]:
                problem = "block digest differs"
            size, digest = block.size, block.payload["sha1"].hexdigest()
            if kind == "revisit":
                size = int(block.fields["content-length"]) if re.fullmatch(r"\d+", block.fields.get("content-length", "")) else None
                digest = told["payload"][1].hex() if told["payload"] and told["payload"][0] == "sha1" else None
                payload = None
            elif told["payload"] and problem is None and block.payload[told["payload"][0]].digest() != told["payload"][1]:
                problem = "payload digest differs"
            yield {
                "offset": offset, "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
                "refers_to": fields.get("warc-refers-to"), "refers_to_uri": fields.get("warc-refers-to-target-uri"), "content_type": fields.get("content-type"), "http_status": block.status,
                "block_bytes": length, "payload_bytes": size, "payload_digest": digest, "payload": payload, "fields": fields, "problem": problem,
            }
    except Damage as e:
        yield {"offset": offset, "problem": f"{e}; the rest of the file is skipped"}


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class Reader(DataSourceReader):
    """A partition is one large file or several small ones."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.keep, self.strict = (options.get(n, "true").lower() != "false" for n in ("payload", "strict"))
        self.together = int(options.get("partition_bytes", 16 << 20))

    def partitions(self):
        out, size = [], 0
        for file, length in archive_files(self.path):
            if not out or size + length > self.together:
                out, size = [*out, []], 0
            out[-1].append(file)
            size += length
        return [Files(f) for f in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for file in partition.files:
            with fs.open_input_stream(file, compression=None) as raw:
                start = raw.read(2)
            with fs.open_input_stream(file, compression=None) as raw:
                for row in records(raw, start == b"\x1f\x8b", self.keep):
                    if self.strict and row["problem"]:
                        raise ValueError(f"{file} at {row['offset']}: {row['problem']}")
                    rows.append({"file": file, **row, "fields": list(row.get("fields", {}).items())})
                    size += len(row.get("payload") or b"") + 1000
                    if size > 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to the session."""
    spark.dataSource.register(WarcSource)


# pages


def page_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows that the writer takes, for pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = saved(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")), "warc-pages")
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    copies = rows.where(F.col("payload_bytes") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row", "url")).alias("first"))
    repeated = saved(copies.where("n > 1").select("key", "first"), "warc-copies")  # a table, so that its size is known when the join is planned
    salted = repeated.select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id"), F.col("row")).alias("record_id"), F.col("url").alias("target_uri"),
        F.when(revisit, name(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
    )


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a record per page to the folder ``path``."""
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").save(path)


def page_of(name: str) -> F.Column:
    """The page id in a record id that ``archive`` wrote."""
    return F.regexp_extract(name, r"^<urn:page:(-?[0-9]*):[0-9]+>$", 1).try_cast("long")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """Pages of archives that ``archive`` wrote: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    register(spark)
    read = spark.read.format("warc").option("payload", "false").load(path)
    return read.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages"), path)
    return archived(spark, path)


SQL = """
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, CAST(encode(coalesce(html, '')) AS BLOB) AS b FROM pages
), q AS (
    SELECT *, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS first,
           row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST, r) AS k FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN first END AS refers_to
FROM q
"""
