"""Operator 4, token ids in a wavelet matrix per shard.

A shard is one self-contained, compressed byte string: a header, the shard's document table, and for every bit of
an id (highest first) one bit-plane with a rank directory. Each plane is stored in blocks that are compressed one by
one, so ``access``, ``rank`` (count) and ``select`` (occurrence lookup) touch only the blocks they need.

File format (little-endian): magic ``MQWM``, version u16, bits u16, n u64 (ids), docs u64, header length u32, then a
JSON header with the byte ranges of every part, then the parts. Parts are Zstandard frames.

Spark writes the shards: each is a binary value in a Parquet file of the shared folder, under Spark's commit protocol,
so a lost executor's attempt leaves nothing behind and the files can be in any store Spark reaches.

Defined results: null text is the empty text (its end id alone); documents are in ascending doc_id order, null first,
equal doc_ids by how their texts begin (64
characters), then by a hash of the whole text; repeated rows are written once each; an empty table writes no shard; further columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, saved, table
from .tokens import encoder, slices

MAGIC, VERSION = b"MQWM", 1
HEAD = struct.Struct("<4sHHQQI")
#: Bits of a plane per compressed block, and per entry of its rank directory.
BLOCK_BITS, RANK_BITS = 1 << 17, 1 << 12
#: Ids per shard at most, unless one document alone has more.
SHARD_IDS = 1 << 21


def build(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, bits: int | None = None) -> bytes:
    """The shard file of ``ids``, the documents' ids one after another (``sizes`` each)."""
    seq = np.ascontiguousarray(ids, dtype=np.uint32)
    bits = bits or max(1, int(seq.max(initial=0)).bit_length())
    seq = seq.astype(np.uint16) if bits <= 16 else seq
    parts: list[bytes] = []
    planes = []

    from zstandard import ZstdCompressor

    pack = ZstdCompressor(level=1).compress

    def put(raw: bytes) -> list[int]:
        parts.append(pack(raw))
        return [sum_at(), len(parts[-1])]

    at = 0

    def sum_at() -> int:
        nonlocal at
        at += len(parts[-1])
        return at - len(parts[-1])

    for level in range(bits - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << level)) != 0
        packed = np.packbits(one, bitorder="little")
        size = BLOCK_BITS // 8
        blocks = [put(packed[i : i + size].tobytes()) for i in range(0, len(packed), size)]
        whole = np.zeros(-(-len(packed) // (RANK_BITS // 8)) * (RANK_BITS // 8), dtype=np.uint8)
        whole[: len(packed)] = packed
        steps = np.bitwise_count(whole.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(steps)]).astype("<u4")
        planes.append({"zeros": int(len(one) - ranks[-1]), "blocks": blocks, "ranks": put(ranks.tobytes())})
        seq = np.concatenate([seq.take(np.flatnonzero(~one)), seq.take(np.flatnonzero(one))])
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    head = {
        "planes": planes,
        "doc_ids": put(np.array([x if x is not None else 0 for x in doc_ids], dtype="<i8").tobytes()),
        "known": put(known.tobytes()),
        "sizes": put(np.asarray(sizes, dtype="<i8").tobytes()),
    }
    text = pack(json.dumps(head, separators=(",", ":")).encode())
    return HEAD.pack(MAGIC, VERSION, bits, len(ids), len(doc_ids), len(text)) + text + b"".join(parts)


class Shard:
    """Reads one shard file; planes are decompressed block by block when they are needed."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.n, self.docs, size = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet shard of this version")
        self.data, self.base = data, HEAD.size + size
        from zstandard import ZstdDecompressor

        self.unpack = ZstdDecompressor().decompress
        self.head = json.loads(self.unpack(data[HEAD.size : self.base]))
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        self.ranks = [self._array(p["ranks"], "<u4") for p in self.head["planes"]]

    def _array(self, place: list[int], kind: str) -> np.ndarray:
        at, size = place
        return np.frombuffer(self.unpack(self.data[self.base + at : self.base + at + size]), dtype=kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        known = self._array(self.head["known"], "u1")
        return [int(x) if k else None for x, k in zip(self._array(self.head["doc_ids"], "<i8"), known, strict=True)], self._array(self.head["sizes"], "<i8")

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self.kept:
            if len(self.kept) > 256:
                self.kept.clear()
            self.kept[key] = self._array(self.head["planes"][plane]["blocks"][block], "u1")
        return self.kept[key]

    def _bit(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._block(plane, block)[rest >> 3] >> (rest & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        step = i // RANK_BITS
        count, at = int(self.ranks[plane][step]), step * RANK_BITS
        if at < i:
            block = self._block(plane, at // BLOCK_BITS)
            lo, hi = (at % BLOCK_BITS) >> 3, ((i - 1) % BLOCK_BITS >> 3) + 1
            part = block[lo:hi]
            count += int(np.bitwise_count(part).sum())
            if i % 8:
                count -= int(np.bitwise_count(np.uint8(int(part[-1]) >> (i % 8))))
        return count

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, plane in enumerate(self.head["planes"]):
            bit, ones = self._bit(p, i), self._ones(p, i)
            i = plane["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``value`` is among positions lo..hi-1."""
        lo, hi = self._range(value, lo, self.n if hi is None else hi)
        return hi - lo

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for p, plane in enumerate(self.head["planes"]):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if value >> (self.bits - 1 - p) & 1:
                lo, hi = plane["zeros"] + a, plane["zeros"] + b
            else:
                lo, hi = lo - a, hi - b
            if lo >= hi:
                return 0, 0
        return lo, hi

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of ``value``; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            zeros = self.head["planes"][p]["zeros"]
            i = self._find(p, i - zeros, 1) if value >> (self.bits - 1 - p) & 1 else self._find(p, i, 0)
        return i

    def _find(self, plane: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * RANK_BITS, self.n) - ranks
        step = int(np.searchsorted(ranks, k, side="right")) - 1
        at = step * RANK_BITS
        block = self._block(plane, at // BLOCK_BITS)
        lo = (at % BLOCK_BITS) >> 3
        bits = np.unpackbits(block[lo : lo + RANK_BITS // 8], bitorder="little")[: self.n - at]
        return at + int(np.flatnonzero(bits == bit)[k - int(ranks[step])])

    def positions(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids, from the planes alone: the stable partitions are undone from the lowest plane up."""
        seq = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            plane = self.head["planes"][p]
            packed = np.concatenate([self._array(b, "u1") for b in plane["blocks"]]) if plane["blocks"] else np.zeros(0, np.uint8)
            one = np.unpackbits(packed, bitorder="little")[: self.n].astype(bool)
            up = np.empty_like(seq)
            up[np.flatnonzero(~one)] = seq[: plane["zeros"]]
            up[np.flatnonzero(one)] = seq[plane["zeros"] :] | seq.dtype.type(1 << (self.bits - 1 - p))
            seq = up
        return seq.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the shards to the shared folder; returns (part, seq, at, docs, ids, file), ascending by (part, seq); ``at`` counts the
    ids before a shard in its part. Ranges end anywhere, also between rows of one doc_id or copies of one row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(text, 1, 64).alias("begin"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "begin", "tie", "row")
    ranged = rows.repartitionByRange(parts or partitions_for(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = at = 0

        def shard() -> pa.RecordBatch:
            file = build(np.concatenate(held), names, np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "at": [at], "docs": [len(names)], "ids": [total], "file": [file]})

        for batch in batches:
            for piece in slices(batch):
                ids, lengths = coder.encode(piece.column(1), end_id)
                names += piece.column(0).to_pylist()
                held.append(ids)
                sizes.append(lengths)
                total += len(ids)
                if total >= SHARD_IDS:
                    yield shard()
                    names, held, sizes, at, total, seq = [], [], [], at + total, 0, seq + 1
        if names:
            yield shard()

    return saved(ranged.mapInArrow(run, "part long, seq long, at long, docs long, ids long, file binary"), "wavelet")


def read_back(shards: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and with ``ids`` the ids, all from the shard files."""
    sums = shards.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row per range partition, however many shards or documents
    base = sums.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("base"))

    def run(batches):
        for batch in batches:
            for start, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(file.as_py())
                names, sizes = shard.documents()
                all_ids = shard.decode().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(all_ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                arrays = [pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.array([all_ids[e - n : e].astype(np.int64) for e, n in zip(ends, sizes, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return shards.join(F.broadcast(base), "part").select(F.col("base") + F.col("at"), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_back(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
