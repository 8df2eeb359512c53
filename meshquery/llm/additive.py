"""Operator 10, approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one codeword from each of ``BOOKS`` full-dimensional codebooks. Codebooks
are fitted to residuals one after another and then jointly by least squares; codes are found by beam search. The index
holds, per row, its codes, the length of its approximation and how far that lies from the row. A query is scored against
every row with one lookup table per codebook; then rows are re-ranked by the exact cosine in double precision on the
original vectors: in each block of the index first the ``FIRST`` best by lookup score, then, without any cap, all whose
lookup score lies less than ``MARGIN`` standard errors below the block's exact k-th. So a group of near copies, whose
lookup scores can't tell them apart, is re-ranked whole, however large it is.

Codebooks are fitted on ``TRAIN_ROWS`` rows at most (those with the smallest hash of their id); every row is indexed.
Of identical vectors only the k + 1 smallest ids can be among a query's k nearest, so the others are left out before
indexing, exactly. Vectors are compared with those of their own length: each length has an index of its own, and so
codebooks of its own.

Plan: index rows are packed in blocks of ``BLOCK_BYTES``, queries in blocks; a block of queries meets each block of the
index (the stated query set against all rows) and sends back k rows per query. Nothing that grows is broadcast, comes to
the driver, or stands in the plan.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
null id; rows repeated with one id and vector count once, of several vectors of one id the best counts; a query with
fewer candidates than k gets all; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import matrix, unit, usable

BOOKS, WORDS, BEAM, FIRST, MARGIN = 12, 256, 4, 32, 2.5
TRAIN_ROWS, ROUNDS, SEED = 16_384, 6, 20_240_604
#: Bytes of an index block's vectors; queries in a block; pairs re-ranked at once.
BLOCK_BYTES, QUERY_BLOCK, PAIRS = 1 << 21, 256, 1 << 14
FOUND = "query_id long, vec_id long, score double"


def _sums(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum of the rows of each word."""
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
    out = np.zeros((WORDS, x.shape[1]), dtype=x.dtype)
    if len(order):
        out[own[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
    return out


def _means(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty word takes the row farthest from its own."""
    words = x[rng.choice(len(x), WORDS, replace=len(x) < WORDS)].copy()
    for _ in range(ROUNDS):
        gap = (words**2).sum(1)[None, :] - 2.0 * (x @ words.T)
        own = gap.argmin(1)
        counts = np.bincount(own, minlength=WORDS)
        sums = _sums(x, own)
        empty = np.flatnonzero(counts == 0)
        words = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            worst = np.argsort(-(gap[np.arange(len(x)), own] + (x**2).sum(1)), kind="stable")[: len(empty)]
            words[empty[: len(worst)]] = x[worst]
    return words.astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n x BOOKS, uint8) by beam search, the lengths of the approximations, and how far these, brought to length
    one, are from the rows."""
    n, wide = x.shape
    codes, lengths, gaps = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
    for a in range(0, n, 1024):
        part = x[a : a + 1024].astype(np.float32)
        m = len(part)
        left = part[:, None, :]
        error = (part**2).sum(1)[:, None]
        path = np.zeros((m, 1, 0), dtype=np.uint8)
        rows = np.arange(m)[:, None]
        for book in books:
            cost = error[:, :, None] + (book**2).sum(1) - 2.0 * (left.reshape(-1, wide) @ book.T).reshape(m, -1, WORDS)
            flat = cost.reshape(m, -1)
            best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
            source, word = best // WORDS, best % WORDS
            left = left[rows, source] - book[word]
            error = flat[rows, best]
            path = np.concatenate([path[rows, source], word[:, :, None].astype(np.uint8)], axis=2)
        first = error.argmin(1)
        codes[a : a + m] = path[np.arange(m), first]
        near = part - left[np.arange(m), first]
        lengths[a : a + m] = np.maximum(np.linalg.norm(near, axis=1), 1e-9)
        gaps[a : a + m] = np.linalg.norm(part - near / lengths[a : a + m, None], axis=1)
    return codes, lengths, gaps


def train(x: np.ndarray) -> np.ndarray:
    """Codebooks (BOOKS x WORDS x width) for unit vectors."""
    rng = np.random.default_rng(SEED)
    left, books = x.astype(np.float32).copy(), []
    for _ in range(BOOKS):
        words = _means(left, rng)
        own = ((words**2).sum(1)[None, :] - 2.0 * (left @ words.T)).argmin(1)
        left -= words[own]
        books.append(words)
    stacked = np.stack(books)
    # Joint update: the codewords that fit the sample best under its beam-searched codes (ridge least squares).
    codes, _, _ = encode(x, stacked)
    size = BOOKS * WORDS
    together, target = np.zeros((BOOKS, WORDS, BOOKS, WORDS)), np.zeros((BOOKS, WORDS, x.shape[1]))
    wide = codes.astype(np.int64)
    for i in range(BOOKS):
        target[i] = _sums(x, wide[:, i])
        for j in range(BOOKS):  # how often two words occur together
            together[i, :, j, :] = np.bincount(wide[:, i] * WORDS + wide[:, j], minlength=WORDS * WORDS).reshape(WORDS, WORDS)
    target = target.reshape(size, -1)
    ridge = together.reshape(size, size) + np.eye(size)
    prior = stacked.reshape(size, -1).astype(np.float64)
    return np.linalg.solve(ridge, target + prior).reshape(stacked.shape).astype(np.float32)


def _rows(batches, size: int):
    """Batches regrouped to ``size`` rows at most, over the whole partition."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(size - count, batch.num_rows)
            held.append(batch.slice(0, take))
            count += take
            batch = batch.slice(take)
            if count == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, vector): rows that can be among somebody's k nearest."""
    copy = W.partitionBy("vector").orderBy("vec_id")
    return vectors.distinct().withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= k + 1).drop("copy")


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(block, ids, codes, lengths, gaps, units): packed index blocks."""
    size = max(64, BLOCK_BYTES // (8 * books.shape[2]))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, got in enumerate(_rows(batches, size)):
            units = unit(matrix(got.column(1)))
            codes, lengths, gaps = encode(units, books)
            parts = {"ids": got.column(0).to_numpy().astype("<i8"), "codes": np.ascontiguousarray(codes.T), "lengths": lengths.astype("<f4"), "gaps": gaps.astype("<f4"), "units": units.astype("<f8")}
            yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + seq])} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

    return rows.select("vec_id", "vector").mapInArrow(run, "block long, ids binary, codes binary, lengths binary, gaps binary, units binary")


def best_of_block(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, gaps: np.ndarray, x: np.ndarray, books: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k nearest of a block for each query, as places in ``asked`` and ``ids``."""
    tables = np.einsum("qd,bwd->qbw", q.astype(np.float32), books)
    got = tables[:, 0].take(codes[0], axis=1)
    for b in range(1, len(books)):
        got += tables[:, b].take(codes[b], axis=1)
    got /= lengths
    own = asked[:, None] == ids[None, :]
    got[own] = -np.inf
    first = np.argpartition(-got, FIRST, axis=1)[:, :FIRST] if got.shape[1] > FIRST else np.broadcast_to(np.arange(got.shape[1]), got.shape)
    exact = np.einsum("qfd,qd->qf", x[first], q)
    exact[np.take_along_axis(own, first, axis=1)] = -np.inf
    edge = -np.partition(-exact, k - 1, axis=1)[:, k - 1] if exact.shape[1] >= k else np.full(len(q), -np.inf)
    reach = got + (MARGIN / np.sqrt(x.shape[1])) * gaps + 1e-6
    wanted = reach >= edge[:, None]
    np.put_along_axis(wanted, first, True, axis=1)
    at, row = np.nonzero(wanted & ~own)
    score = np.concatenate([np.einsum("ij,ij->i", x[row[i : i + PAIRS]], q[at[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]) if len(at) else np.zeros(0)
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], row[place < k], score[place < k]


def nearest(queries: DataFrame, blocks: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k nearest of every block of the index."""

    def pack(batches):
        for got in _rows(batches, QUERY_BLOCK):
            yield pa.RecordBatch.from_pydict({"asked": pa.array([got.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), "q": pa.array([unit(matrix(got.column(1))).astype("<f8").tobytes()], pa.binary())})

    packed = saved(queries.select("vec_id", "vector").mapInArrow(pack, "asked binary, q binary"), "queries")
    names = saved(blocks.select("block", (F.row_number().over(W.orderBy("block")) - 1).alias("at")), "blocks")  # a number per block
    count = names.count()
    if not count:
        return queries.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in FOUND.split(", "))])
    meet = packed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(names, "at")
    pairs = meet.join(blocks, "block").select("asked", "q", "ids", "codes", "lengths", "gaps", "units")

    def score(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in enumerate(("<i8", "<f8", "<i8", np.uint8, "<f4", "<f4", "<f8"))]
                asked, ids = raw[0], raw[2]
                at, near, exact = best_of_block(asked, raw[1].reshape(len(asked), -1), ids, raw[3].reshape(len(books), -1), raw[4], raw[5], raw[6].reshape(len(ids), -1), books, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids[near]), pa.array(exact)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(score, FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` where ``is_query`` holds."""
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    found = vectors.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in FOUND.split(", "))])
    for width in sorted(r.width for r in rows.select(F.size("vector").alias("width")).distinct().collect()):  # one index per length
        own = rows.where(F.size("vector") == width)
        able = saved(candidates(own.select("vec_id", "vector"), k), "candidates")
        queries = saved(own.where("asks").select("vec_id", "vector").distinct(), "asked")
        sample = able.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("vector").toArrow()
        books = train(unit(matrix(sample.column(0))))
        found = found.unionByName(nearest(queries, saved(index(able, books), "index"), books, k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
