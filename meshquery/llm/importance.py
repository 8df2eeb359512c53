"""Operator 12, importance resampling towards a target distribution, by word-id suffix arrays.

Texts of a partition become word ids, one end mark after each text, a bounded slice at a time. A suffix array over the
ids brings equal runs of words together; common prefixes of neighbours (LCP), cut at ``longest`` words and at end marks,
delimit the runs of equal k-grams. Each distinct k-gram is hashed once, by lengthening the checksum of its first k - 1
words, and its hash is scattered back to all places where it stands. A document's bucket ids are kept as one binary.

Plan: one pass over the texts writes bucket ids (two bytes a feature); counts per bucket are summed inside each task, so
at most ``buckets`` rows a task are shuffled and ``buckets`` rows reach the driver; gains go by value to the pass that
weighs documents; the draw is a range sort of narrow rows, ranked by one base per partition. Texts move nowhere.

Defined results: null text has no words; a text of k words has the runs it has (one word: one feature, none: none and
weight 0); repeated rows are features and candidates each; null doc_id hashes as the empty string and comes last among
equal scores; an empty table gives no rows, an empty target has no features; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import slices

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, "7"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def word_ids(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word ids (from 1) of all texts with a 0 after each text, the words, and how many words each text has."""
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64, count=len(texts) + 1)
    low = _LOWER[np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1]))] if data and offsets[-1] else np.zeros(0, np.uint8)
    inside = _WORD[low]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    kept = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    bounds = np.append(kept[start], kept[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[inside]))]).dictionary_encode()
    counts = np.diff(np.searchsorted(start, offsets))
    ids = np.zeros(len(start) + len(texts), dtype=np.int64)
    ids[np.arange(len(start)) + np.repeat(np.arange(len(texts)), counts)] = words.indices.to_numpy() + 1
    return ids, words.dictionary.to_pylist(), counts


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of words, ordered by (at least) the ``depth`` ids from each place on; by doubling."""
    rank, span = ids, 1
    while True:
        after = np.zeros_like(rank)
        if span < depth:
            after[:-span] = rank[span:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        if span * 2 >= depth:
            order = np.argsort(key, kind="stable")
            return order[ids[order] > 0]
        rank, span = np.unique(key, return_inverse=True)[1] + 1, span * 2


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each suffix has in common with the one before it; at most ``depth``, none beyond an end mark."""
    padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    lcp, same = np.zeros(len(order), dtype=np.int64), np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(depth):
        here = padded[order[1:] + k]
        same &= (padded[order[:-1] + k] == here) & (here > 0)
        lcp[1:] += same
    return lcp


def gram_hashes(texts: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``longest`` words, text by text; runs per text; words per text."""
    ids, words, counts = word_ids(texts)
    order = suffix_array(ids, longest)
    lcp = common_prefixes(ids, order, longest)
    padded = np.concatenate([ids, np.zeros(longest, dtype=ids.dtype)])
    found = np.zeros((len(ids), longest), dtype=np.uint32)
    there = np.zeros((len(ids), longest), dtype=bool)
    more = [b"", *(b" " + w for w in words)]
    long_enough = np.ones(len(order), dtype=bool)
    for k in range(longest):
        last = padded[order + k]
        long_enough &= last > 0
        places = order[long_enough]
        heads = lcp[long_enough] <= k
        if len(heads):
            heads[0] = True
        first, added = places[heads], last[long_enough][heads].tolist()
        if k:
            runs = np.fromiter((zlib.crc32(more[w], c) for w, c in zip(added, found[first, k - 1].tolist(), strict=True)), dtype=np.uint32, count=len(added))
        else:
            runs = np.fromiter((zlib.crc32(words[w - 1]) for w in added), dtype=np.uint32, count=len(added))
        found[places, k] = runs[np.cumsum(heads) - 1] if len(heads) else 0
        there[places, k] = True
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    per_text = np.bincount(owner, weights=there.sum(axis=1), minlength=len(counts)).astype(np.int64)
    return found[there], per_text, counts


def _blobs(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(lengths)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all binaries of a column, and how many each has."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // kind.itemsize
    _, places, data = column.buffers()
    first = np.frombuffer(places, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=kind, count=int(lengths.sum()), offset=int(first)) if data else np.zeros(0, kind), lengths


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def hashed(docs: DataFrame, row: Column | None = None, id_col: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(row, doc_id, words, n_features, features binary of bucket ids) for every row; ``row`` numbers rows, by default freely."""
    kind = _kind(buckets)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, per_text, counts = gram_hashes(part.column("text"), longest)
                blobs = _blobs((hashes % np.uint32(buckets)).astype(kind), per_text)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(counts), pa.array(per_text), blobs], names=["row", "doc_id", "words", "n_features", "features"])

    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, words long, n_features long, features binary")


def counted(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the target's smoothed share of each bucket over the corpus's, as whole numbers."""
    n, all_have, all_want = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_have + n)) / ((s + 1.0) * (all_want + n)))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], dtype=np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, words, n_features, weight): the floored mean of a document's gains."""
    kind = _kind(len(gain))

    def run(batches):
        for batch in batches:
            flat, lengths = _flat(batch.column(4), kind)
            total = np.concatenate([[0], np.cumsum(gain[flat])])
            ends = np.cumsum(lengths)
            weight = (total[ends] - total[ends - lengths]) // np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(weight)], names=["row", "doc_id", "words", "n_features", "weight"])

    return features.mapInArrow(run, "row long, doc_id long, words long, n_features long, weight long")


def noise(seed: str = SEED) -> Column:
    """A Gumbel number of the id, in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def _numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` range-sorted by falling score, with the partition and the place in it."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "at"])
            at += n

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, part long, at long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED, row: Column | None = None) -> DataFrame:
    """(row, doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); the drawn ``percent`` of those with
    ``least_words`` words have a rank from 1."""
    spark = docs.sparkSession
    features = saved(hashed(docs, row, buckets=buckets, longest=longest), "importance-features")
    aim = saved(hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets=buckets, longest=longest), "importance-target")
    gain = gains(counted(features, buckets), counted(aim, buckets))
    scored = saved(weighed(features, gain).withColumn("score", F.col("weight") + noise(seed)), "importance-scores")
    able = F.col("words") >= least_words
    ordered = saved(_numbered(scored.where(able), int(spark.conf.get("spark.sql.shuffle.partitions"))), "importance-order")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per range partition
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    drawn = at * percent // 100
    bases = F.broadcast(spark.createDataFrame(before, "part long, base long"))
    place = F.col("base") + F.col("at") + 1
    columns = ["row", "doc_id", "n_features", "weight", "score"]
    ranked = ordered.join(bases, "part").select(*columns, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns; ``how`` as for ``resample``."""
    name = f"row_{uuid.uuid4().hex}"
    numbered = saved(docs.withColumn(name, F.monotonically_increasing_id()), "importance-docs")
    ranks = resample(numbered, target, row=F.col(name), **how).where(F.col("rank").isNotNull()).select(F.col("row").alias(name))
    return numbered.join(ranks, name, "left_semi").select(*[numbered[f"`{c}`"] for c in docs.columns])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
