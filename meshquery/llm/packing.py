"""Operator 1, packing along a space-filling curve.

Each document becomes a hashed bag-of-ids vector, a fixed random projection takes it to three coordinates, the
coordinates' corpus mean and deviation scale them to a cube, and the cell's Hilbert index orders the corpus. The
ids are laid end to end in that order and cut every ``length`` ids, so neighbours share sequences and only the
last sequence of the corpus can have padding.

Plan: one pass over the text writes ids and coordinates; the order is a range shuffle of narrow rows (ties and
copies are split by row number, so equal keys spread over tasks); running totals are kept within partitions and
joined with one base per partition; ids move once, in a shuffle by unique row number.

Defined results: null text is the empty text; a text without ids has its end id alone; repeated rows (equal ids
too) are packed once each; null doc_id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import encoder, slices

BUCKETS, DIMS, BITS = 256, 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points (n x d), by Skilling's transposed Gray-code transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int = 20_240_601) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def coordinates(flat: np.ndarray, lengths: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Signed hashed counts, square-rooted and of unit length, projected to DIMS numbers per document."""
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.float32)
    out = np.zeros((len(lengths), DIMS), dtype=np.float32)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for a in range(0, len(lengths), 512):
        b = min(a + 512, len(lengths))
        lo, hi = starts[a], starts[b]
        owner = np.repeat(np.arange(b - a), lengths[a:b])
        counts = np.bincount(owner * BUCKETS + bucket[lo:hi], weights=sign[lo:hi], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        vector = np.sign(counts) * np.sqrt(np.abs(counts))
        norm = np.linalg.norm(vector, axis=1, keepdims=True)
        out[a:b] = (vector / np.where(norm > 0, norm, 1.0)) @ projection
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row long, doc_id, n long, ids binary of little-endian uint16 or uint32, x0.. float); row is unique."""

    def run(batches):
        coder, projection = encoder(tokenizer), _projection()
        kind = np.dtype("<u2") if len(coder.edge) <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for part in slices(batch):
                flat, lengths = coder.encode(pc.fill_null(part.column(2), ""))
                places = coordinates(flat, lengths, projection)
                ends = np.cumsum(lengths)
                ids = np.insert(flat.astype(kind), ends, end_id)
                bounds = (np.concatenate([[0], np.cumsum(lengths + 1)]) * kind.itemsize).astype(np.int64)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths + 1), blob.cast(pa.binary()), *(pa.array(places[:, i]) for i in range(DIMS))], names=["row", "doc_id", "n", "ids", *(f"x{i}" for i in range(DIMS))])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, ids binary, " + ", ".join(f"x{i} float" for i in range(DIMS)))


def curve_keys(batches, means: list[float], spreads: list[float]):
    from math import sqrt

    for batch in batches:
        z = np.stack([(batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) - m) / s for i, (m, s) in enumerate(zip(means, spreads, strict=True))], axis=1)
        unit = 0.5 * (1.0 + np.tanh(z * sqrt(2.0 / np.pi)))  # close to the normal distribution function
        cells = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_index(cells, BITS))], names=["row", "n", "key"])


def ordered(narrow: DataFrame, parts: int) -> DataFrame:
    """(row, n, part, at): rows range-sorted by (key, row); ``at`` counts the ids before a row in its partition."""

    def running(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(ends - n)], names=["row", "n", "part", "at"])

    return narrow.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").mapInArrow(running, "row long, n long, part long, at long")


def bases(order: DataFrame) -> DataFrame:
    """(part, base): ids before each partition. One row per shuffle partition comes to the driver, never one per document."""
    sums = sorted((r.part, r.total) for r in order.groupBy("part").agg(F.sum("n").alias("total")).collect())
    at, rows = 0, []
    for part, total in sums:
        rows.append((part, at))
        at += total
    return order.sparkSession.createDataFrame(rows, "part long, base long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, ids: bool = True) -> DataFrame:
    """Pieces of packed documents: PIECES, and with ``ids`` each piece's ids (array<int>), sorted nowhere in particular."""
    spark = docs.sparkSession
    tokens = saved(encoded(docs, tokenizer, end_id), "pack-ids")
    places = [f"x{i}" for i in range(DIMS)]
    got = tokens.agg(*[F.avg(c).alias(f"m{c}") for c in places], *[F.stddev_pop(c).alias(f"s{c}") for c in places], F.count("*").alias("rows")).first()
    means = [got[f"m{c}"] or 0.0 for c in places]
    spreads = [max(got[f"s{c}"] or 0.0, 1e-6) for c in places]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = tokens.select("row", "n", *places).mapInArrow(lambda b: curve_keys(b, means, spreads), "row long, n long, key long")
    order = saved(ordered(narrow, parts), "pack-order")
    placed = order.join(F.broadcast(bases(order)), "part").select("row", (F.col("base") + F.col("at")).alias("place"))
    wide = tokens.select("row", "doc_id", "n", "ids").join(placed, "row").select("doc_id", "n", "place", "ids")

    def cut(batches):
        for batch in batches:
            kind = None
            names, sizes, places_, blobs = (batch.column(i) for i in range(4))
            out: list[list] = [[] for _ in range(8)]
            for doc, n, place, blob in zip(names.to_pylist(), sizes.to_pylist(), places_.to_pylist(), blobs, strict=True):
                raw = np.frombuffer(blob.as_buffer(), dtype=kind or (kind := np.dtype(f"<u{len(blob.as_buffer()) // n}"))).astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(place + done, length)
                    take = min(length - offset, n - done)
                    piece = raw[done : done + take]
                    for column, value in zip(out, (doc, done, take, zlib.crc32(piece.tobytes()), n, sequence, offset, piece.astype(np.int32) if ids else None), strict=True):
                        column.append(value)
                    done += take
            arrays = [pa.array(c, pa.int64()) for c in out[:7]]
            if ids:
                arrays.append(pa.array(out[7], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids)

    return wide.mapInArrow(cut, PIECES + ", ids array<int>" * ids)


def padding(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, ids and padding (a sequence that ends at a power of two needs none)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    pads = F.when(F.pmod("used", F.lit(length)) == 0, 0).when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(length - F.col("used"))
    return used.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).alias("ids"), F.coalesce(F.sum(pads), F.lit(0)).alias("padding"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
