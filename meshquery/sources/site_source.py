"""Binary site files as a Spark data source.

``sites(nodes, edges, actions).write.format("sitefile").save(folder)`` writes one file per site; ``spark.read.format("sitefile").option("part",
"nodes" | "edges" | "actions").load(folder)`` reads them, several files a task. A write has a folder of its own, which counts only
once the driver has committed it; files of lost attempts are never read. A filter on ``domain`` (equal, or in a list) is pushed to the reader:
of other sites' files only the heads are read."""

from __future__ import annotations

import json
import posixpath
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.graph import dealt_by
from .site_files import ACTION, COUNTS, CTX_MAGIC, CTX_VERSION, EDGE, HEAD, NODE, PARTS, WIDTH, BadFile, site_slices


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema, self.part = options["path"], schema, options.get("part", "nodes")
        self.together = int(options.get("partition_bytes", 16 << 20))
        self.only: set[str] | None = None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("domain",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self):
        fs, at = _fs(self.path)
        own = fs.get_file_info(at)
        if own.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [own] if own.is_file else [i for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.is_file]
        told: set[str] = set()
        for i in listed:
            if i.base_name == "_committed":
                with fs.open_input_stream(i.path) as f:
                    told |= {posixpath.join(posixpath.dirname(i.path), n) for n in json.loads(f.read())}
        loose = lambda path: not posixpath.basename(posixpath.dirname(path)).startswith("write-")
        files = sorted((i.path, i.size) for i in listed if i.base_name.endswith(".ctx") and (i.path in told or loose(i.path)))
        out, size = [], 0
        for file, length in files:
            if not out or size + length > self.together:
                out, size = [*out, []], 0
            out[-1].append(file)
            size += length
        return [Files(f) for f in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        form = to_arrow_schema(self.schema)
        for file in partition.files:
            with fs.open_input_file(file) as raw:
                head = raw.read(HEAD.size)
                if len(head) < HEAD.size:
                    raise BadFile(f"{file}: truncated")
                name = raw.read(HEAD.unpack(head)[2])
                if self.only is not None and name.decode("utf-8", "replace") not in self.only:
                    continue
                try:
                    for rows in site_slices(raw, self.part, raw.size()):
                        yield from pa.Table.from_pandas(rows, form, preserve_index=False).to_batches(20_000)
                except (BadFile, struct.error) as e:
                    raise BadFile(f"{file}: {e}") from None


#: A site's rows in the order that its file needs them: the numbers of its pages, what must be counted before it is written, then the wide parts.
IDS, EDGES, ACTIONS, NODES, FEATURES, URLS = range(6)
#: A file is written in pieces of so many bytes.
PIECE = 4 << 20


def _fitting(values: np.ndarray, kind: str) -> np.ndarray:
    told = np.iinfo(kind)
    if len(values) and (values.min() < told.min or values.max() > told.max):
        raise OverflowError(f"{values.min()} to {values.max()} don't fit {kind}")
    return values.astype(kind)


class _Site:
    """A site's file made of its rows as they come. In memory are 22 bytes a page at most and a piece; edges and actions wait in temporary files
    until all are counted."""

    def __init__(self, domain: str | None):
        self.domain, self.check, self.out, self.begun, self.last = domain, 0, bytearray(), False, IDS
        self.ids, self.clusters, self.lengths, self.held = [], [], [], None
        self.edges, self.actions = (tempfile.SpooledTemporaryFile(PIECE) for _ in range(2))

    def _put(self, content: bytes) -> Iterator[tuple]:
        self.check = zlib.crc32(content, self.check)
        self.out += content
        if len(self.out) >= PIECE:
            yield self._piece()

    def _piece(self) -> tuple:
        first, self.begun = not self.begun, True
        content, self.out = bytes(self.out), bytearray()
        return self.domain, first, content

    def _numbered(self) -> None:
        self.ids, self.clusters, self.lengths = (np.concatenate(x) for x in (self.ids, self.clusters, self.lengths))
        self.twice = bool((self.ids[1:] == self.ids[:-1]).any())
        self.counts = {EDGES: np.zeros(len(self.ids), "<u4"), ACTIONS: np.zeros(len(self.ids), "<u4")}

    def _places(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of page numbers, and which are there."""
        if self.twice:
            raise ValueError(f"{self.domain}: a page's number is there twice")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return place, known & (self.ids[place] == ids)

    def _count(self, kind: int, owners: np.ndarray) -> None:
        own, n = np.unique(owners, return_counts=True)
        self.counts[kind][own] += n.astype("<u4")

    def _index(self, kind: int) -> bytes:
        return np.concatenate([[0], np.cumsum(self.counts[kind], dtype=np.int64)]).astype("<u4").tobytes()

    def _told(self, batch: pa.RecordBatch, names: str, known: np.ndarray) -> list[np.ndarray]:
        return [batch.column(c).filter(pa.array(known)).to_numpy() for c in names]

    def _linked(self, batch: pa.RecordBatch) -> None:
        (src, from_), (dst, to) = (self._places(batch.column(c)) for c in "ab")
        known = from_ & to
        rows = np.zeros(int(known.sum()), EDGE)
        for name, values in zip(("dst", "edge_type", "weight", "flags"), (dst[known], *self._told(batch, "cde", known)), strict=True):
            rows[name] = _fitting(values, EDGE[name].str)
        self.edges.write(rows.tobytes())
        self._count(EDGES, src[known])

    def _acted(self, batch: pa.RecordBatch | None) -> None:
        """Actions go by their target's place: those of the last page and code wait until it is sure that no more come."""
        rows = self.held
        if batch is not None:
            (node, known), (target, there) = (self._places(batch.column(c)) for c in "ac")
            code, cost, risk = self._told(batch, "bde", known)
            more = np.stack([node[known], code, np.where(there, target, -1)[known], cost, risk])
            rows = more if rows is None else np.concatenate([rows, more], axis=1)
        if rows is None or not rows.shape[1]:
            return
        rows = rows[:, np.lexsort(rows[::-1])]
        ready = rows.shape[1] if batch is None else int(np.argmax((rows[:2] == rows[:2, -1:]).all(axis=0)))
        self.held, rows = (None if batch is None else rows[:, ready:]), rows[:, :ready]
        coded = np.zeros(rows.shape[1], ACTION)
        for name, values in zip(("opcode", "target", "cost", "risk"), rows[1:], strict=True):
            coded[name] = _fitting(values, ACTION[name].str)
        self.actions.write(coded.tobytes())
        self._count(ACTIONS, rows[0])

    def _kept(self, file) -> Iterator[tuple]:
        file.seek(0)
        while content := file.read(PIECE):
            yield from self._put(content)
        file.close()

    def _next(self, kind: int) -> Iterator[tuple]:
        """What stands in the file before the part that rows of this kind make."""
        if kind == NODES:
            self._acted(None)
            name = (self.domain or "").encode()
            self.edge_count, self.action_count = (int(self.counts[k].sum(dtype=np.int64)) for k in (EDGES, ACTIONS))
            yield from self._put(HEAD.pack(CTX_MAGIC, CTX_VERSION, len(name)) + name + COUNTS.pack(0, len(self.ids), self.edge_count, 0, 0))
        elif kind == FEATURES:
            yield from self._kept(self.edges)
            yield from self._put(self._index(EDGES))
        elif kind == URLS:
            yield from self._put(struct.pack("<I", self.action_count))
            yield from self._kept(self.actions)
            yield from self._put(self._index(ACTIONS) + _fitting(self.clusters, "<u2").tobytes())
            yield from self._put(struct.pack("<I", int(self.lengths.sum(dtype=np.int64))))

    def taken(self, kind: int, batch: pa.RecordBatch) -> Iterator[tuple]:
        """The pieces that are ready after some rows of one kind."""
        if kind == IDS:
            self.ids.append(batch.column("a").to_numpy())
            self.clusters.append(batch.column("c").to_numpy().astype(np.int32))
            self.lengths.append(batch.column("d").to_numpy().astype("<u4"))
            return
        if not len(self.ids):  # a site without pages
            return
        if self.last == IDS:
            self._numbered()
        for k in range(max(self.last + 1, NODES), kind + 1):
            yield from self._next(k)
        self.last = kind
        if kind == EDGES:
            self._linked(batch)
        elif kind == ACTIONS:
            self._acted(batch)
        else:
            yield from self._put(b"".join(batch.column("content").to_pylist()))

    def ended(self) -> Iterator[tuple]:
        if len(self.ids):
            offsets = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)[:-1]])
            yield from self._put(offsets.astype("<u4").tobytes())
            self.out += struct.pack("<I", self.check)
            yield self._piece()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bool, bytes]]:
    """(domain, whether a file begins, bytes) of rows of ``sites``; rows (domain, content) are whole files."""
    site = None
    for batch in batches:
        if "kind" not in batch.schema.names:
            yield from ((d, True, c.as_buffer()) for d, c in zip(batch.column("domain").to_pylist(), batch.column("content"), strict=True))
        elif batch.num_rows:
            domains, kinds = np.array(batch.column("domain").to_pylist(), dtype=object), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((domains[1:] != domains[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if site is None or domains[i] != site.domain:
                    yield from site.ended() if site else ()
                    site = _Site(domains[i])
                yield from site.taken(int(kinds[i]), batch.slice(i, j - i))
    yield from site.ended() if site else ()


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.folder = options["path"], overwrite, f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _fs(self.path)
        fs.create_dir(posixpath.join(at, self.folder), recursive=True)
        files, out = [], None
        try:
            for domain, first, content in pieces(iterator):
                if first:
                    if out is not None:
                        out.close()
                    name = posixpath.join(at, self.folder, f"{quote(domain or '', safe='.')[:150]}-{uuid.uuid4().hex}.ctx")
                    out = fs.open_output_stream(name, compression=None)
                    files.append(posixpath.basename(name))
                out.write(content)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, at = _fs(self.path)
        fs.create_dir(posixpath.join(at, self.folder), recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.startswith("write-") and i.base_name != self.folder] if self.overwrite else []
        with fs.open_output_stream(posixpath.join(at, self.folder, "_committed"), compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        for path in old:
            fs.delete_dir(path)

    def abort(self, messages) -> None:
        fs, at = _fs(self.path)
        if fs.get_file_info(posixpath.join(at, self.folder)).type != pafs.FileType.NotFound:
            fs.delete_dir(posixpath.join(at, self.folder))


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitefile"

    def schema(self) -> str:
        return PARTS[self.options.get("part", "nodes")]

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("sitefile")`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteSource)


_FIELDS = {"freshness": "freshness", "content_hash": "content_hash", "rendered_at": "rendered_at", "http_status": "http_status", "depth": "depth", "inbound_count": "inbound", "outbound_count": "outbound"}


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as a site file has them."""

    def blocks(content: np.ndarray, width: int) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(content), [None, pa.py_buffer(content.tobytes())]).cast(pa.binary())

    for batch in batches:
        pages = batch.select([c for c in batch.schema.names if c != "features"]).to_pandas()
        wide = batch.column("features")
        if not pa.compute.all(pa.compute.equal(wide.value_lengths().fill_null(0), WIDTH), min_count=0).as_py():
            raise ValueError(f"a page's features are not {WIDTH} numbers")
        features = wide.flatten().to_numpy(zero_copy_only=False).reshape(len(pages), WIDTH)
        table = np.zeros(len(pages), dtype=NODE)
        for name in ("page_type", "confidence", "flags"):
            table[name] = pages[name]
        for column, name in _FIELDS.items():
            if column in pages:
                table[name] = pages[column].fillna(0)
        table["norm"] = np.linalg.norm(features, axis=1)
        cluster = pages.cluster.fillna(0).astype("int64") if "cluster" in pages else np.zeros(len(pages), "int64")
        urls = pa.array([u.encode() + b"\0" for u in pages.url], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("domain").cast(pa.string()), batch.column("node_id"), pa.array(cluster, pa.int64()), blocks(table, NODE.itemsize), blocks(features.astype("<f4"), 4 * WIDTH), urls], names=["domain", "node_id", "cluster", "node", "features", "url"])


def sites(nodes: DataFrame, edges: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Rows that ``format("sitefile")`` writes as a file per site, of nodes (domain, node_id, url, page_type, confidence, flags, features, and any other
    field of a node that is there, and cluster), edges (domain, src, dst, edge_type, weight, flags) and actions (domain, node_id, category, action,
    target_node, cost_hint, risk). Nodes are numbered in the order of node_id; edges and actions of other nodes are left out. A file, and so a site,
    is one task's, which gets its rows sorted and never holds them all: a page is a row in each part of the file that has something of it."""
    more = [c for c in (*_FIELDS, "cluster") if c in nodes.columns]
    slim = nodes.select("domain", F.col("node_id").cast("long").alias("node_id"), "url", "page_type", "confidence", "flags", "features", *more)
    pages = slim.mapInArrow(_encoded, "domain string, node_id bigint, cluster bigint, node binary, features binary, url binary")
    empty = F.lit(None).cast("binary")
    row = lambda kind, a, b, c, d, e, content: [F.lit(kind).alias("kind"), *[x.cast("long").alias(n) for n, x in zip("abcde", (a, b, c, d, e), strict=True)], content.alias("content")]
    none, tie, size = F.lit(0), F.xxhash64("node", "features", "url"), F.octet_length("url")  # pages of one number stay in one order in all parts
    part = lambda kind, content: F.struct(*row(kind, F.col("node_id"), tie, F.col("cluster") if kind == IDS else none, size if kind == IDS else none, none, content))
    every = pages.select("domain", F.explode(F.array(part(IDS, empty), part(NODES, F.col("node")), part(FEATURES, F.col("features")), part(URLS, F.col("url")))).alias("x")).select("domain", "x.*")
    if edges is not None:
        every = every.unionByName(edges.select("domain", *row(EDGES, *map(F.col, ("src", "dst", "edge_type", "weight", "flags")), empty)))
    if actions is not None:
        opcode = F.col("category") * 256 + F.col("action")
        every = every.unionByName(actions.select("domain", *row(ACTIONS, F.col("node_id"), opcode, F.col("target_node"), F.col("cost_hint"), F.col("risk"), empty)))
    return dealt_by(every, "domain").sortWithinPartitions("domain", "kind", *"abcde")
