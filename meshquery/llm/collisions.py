"""Operator 7, near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Unit vectors of cosine >= 0.98 differ by at most 0.2, so on a random line their places differ by a normal amount of
deviation 0.2 at most, where unrelated vectors differ by 1.4. Rows are sorted by a projection; around each row a window
of half-width ``WINDOW`` says which rows collide with it; a pair that collides on at least ``COUNT`` of ``LINES`` lines
is verified by its cosine in double precision. COUNT is the largest count that a pair at the threshold still reaches
with probability 1 - ``MISS``.

Counting costs less than the cosines that it saves. Rows stand in the order of a first line, and stretches of it meet only
what lies within ``REACH`` deviations of them; places on the other lines are single bytes; after half of the lines, pairs
that can no longer reach COUNT are dropped, and the few others are counted one by one.

To count without meeting everyone, vectors are dealt into cells by further projections cut into steps (several
independent tables). How many projections cut a cell, ``DEPTH`` at most, is what needs least work in all (``best_depth``). The
number of tables follows from that depth so that a pair at the threshold shares a cell of some table with
probability 1 - MISS. Cells that stay large (rows that really are alike) are split into blocks, and pairs of blocks are
tasks of bounded size. A block sends out no pairs: link counts per vector, and a spanning forest of its links. A pair
that shares cells of several tables is counted in the first one.

Identical vectors of one label are one class with a multiplicity, so copies are never compared with each other.

Defined results: only vectors of one length and equal, non-null labels are compared; vectors that are null, zero or hold
null or non-finite components have n_links 0 and stand alone; repeated rows are copies linked with each other; null
vec_id takes part but names no component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import saved, table
from .components import components
from .vectors import matrix, unit, usable

THRESHOLD, LINES, WINDOW, STEP = 0.98, 24, 0.5, 1.2
MISS, CELL, BLOCK, DEPTH, TABLES = 1e-4, 8192, 2048, 12, 64
#: Half-width of what a row meets on the sorted line, in deviations of a pair at the threshold (missed: under MISS).
REACH = 4.0
#: Places of a line are kept in bytes, this many to one.
SCALE = 32
SEED = 20_240_603


def collision_count(threshold: float = THRESHOLD, lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold misses with probability ``miss`` at most."""
    p = erf(window / sqrt(2.0 * (2.0 - 2.0 * threshold)))
    below = 0.0
    for k in range(lines + 1):
        below += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def tables_for(depth: int, threshold: float = THRESHOLD, step: float = STEP, miss: float = MISS) -> int:
    """Tables in which a pair at the threshold shares a cell at least once, with probability 1 - miss."""
    if not depth:
        return 1
    s = sqrt(2.0 - 2.0 * threshold) / step
    same = erf(1 / (s * sqrt(2))) - s * sqrt(2 / pi) * (1 - exp(-1 / (2 * s * s)))  # of one projection's steps
    return max(1, min(TABLES, ceil(log(miss) / log(1 - same**depth))))


def best_depth(met: dict[int, tuple[int, float, int]]) -> int:
    """The depth of least work, from the rows, the pairs within cells and the cells of several rows at each depth. Every table meets those
    pairs, moves every row (worth a quarter of CELL pairs) and opens every cell (24 times CELL pairs, as measured). Unlike rows part
    at each step, so large groups of them are cut deep; alike rows hardly do, and are met in few tables."""
    work = {d: tables_for(d) * (pairs + CELL * (rows / 4 + cells * 24)) for d, (rows, pairs, cells) in met.items()}
    return min(work, key=lambda d: (work[d], d), default=0)


def _random(width: int, columns: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, salt]).standard_normal((width, columns))


def steps_of(rows: np.ndarray, table_no: int, depth: int) -> np.ndarray:
    """Cut projections of unit vectors: rows x depth small integers."""
    shift = np.random.default_rng([SEED, 7, table_no]).uniform(0, STEP, DEPTH)
    return np.floor((rows @ _random(rows.shape[1], DEPTH, 1 + table_no) + shift)[:, :depth] / STEP).astype(np.int64)


def _hash(group: np.ndarray, steps: np.ndarray) -> np.ndarray:
    out = group.astype(np.uint64).copy()
    for d in range(steps.shape[1]):
        out = (out ^ (steps[:, d].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _numbers(vectors: DataFrame) -> Column:
    """The vectors as they are if of floats, which take half of the room, else of doubles."""
    kind = vectors.schema["embedding"].dataType
    return F.col("embedding") if kind == ArrayType(FloatType()) else F.col("embedding").cast("array<double>")


def classes_of(vectors: DataFrame) -> DataFrame:
    """(cls, label, vector, copies, low): one row per distinct (label, vector) that takes part."""
    fit = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), _numbers(vectors).alias("vector"), F.monotonically_increasing_id().alias("row"))
    return rows.groupBy("label", "vector").agg(F.min("row").alias("cls"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))


def cells(classes: DataFrame) -> DataFrame:
    """(table, cell, cls, copies, vector, codes): a row per class and table; codes are hashes of its cells in all tables."""
    group = classes.select("cls", "copies", F.xxhash64("label", F.size("vector")).alias("group"), "vector")

    def prefixes(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for _, part in pdf.groupby(pdf.vector.map(len)):
                steps = steps_of(unit(np.stack(part.vector)), 0, DEPTH)
                for depth in range(DEPTH + 1):
                    yield pd.DataFrame({"depth": depth, "cell": _hash(part.group.to_numpy(), steps[:, :depth])})

    # The first table stands for all: the tables are alike but for their random lines.
    counts = group.mapInPandas(prefixes, "depth int, cell long").groupBy("depth", "cell").agg(F.count("*").alias("rows"))
    sums = counts.groupBy("depth").agg(F.sum("rows").alias("rows"), F.sum(F.pow("rows", F.lit(2.0))).alias("pairs"), F.count_if(F.col("rows") > 1).alias("cells"))
    met = {r.depth: (r.rows, r.pairs, r.cells) for r in sums.collect()}  # a row per depth
    depth = best_depth(met)
    tables = tables_for(depth)

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for _, part in pdf.groupby(pdf.vector.map(len)):
                rows = unit(np.stack(part.vector))
                codes = np.stack([_hash(part.group.to_numpy() + t, steps_of(rows, t, depth)) for t in range(tables)], axis=1)
                for t in range(tables):
                    yield pd.DataFrame({"table": t, "cell": codes[:, t], "cls": part.cls.to_numpy(), "copies": part.copies.to_numpy(), "vector": part.vector.to_numpy(), "codes": list(codes.astype(np.int32)[:, :t])})

    return group.mapInPandas(deal, f"table int, cell long, cls long, copies long, vector {classes.schema['vector'].dataType.simpleString()}, codes array<int>")


def blocks(dealt: DataFrame) -> DataFrame:
    """Cells in blocks of about BLOCK rows, each pair of blocks a group (cell, i, j); side 0 holds i, side 1 holds j."""
    sizes = dealt.groupBy("table", "cell").agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = dealt.join(sizes, ["table", "cell"]).withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), (F.col("block") > k).cast("int").alias("side")))
    return own.withColumn("pair", F.explode(pairs)).select("table", "cell", "pair.i", "pair.j", "pair.side", "cls", "copies", "vector", "codes")


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what (x, y) connects, fewer than n."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def collided(own: np.ndarray, others: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of two tables of places (rows x LINES) that collide on ``need`` lines or more."""
    reach = REACH * sqrt(2.0 - 2.0 * THRESHOLD)
    mine, theirs = np.argsort(own[:, 0], kind="stable"), np.argsort(others[:, 0], kind="stable")
    steps = lambda places: (np.clip(places, -3.9, 3.9) * SCALE + 128).astype(np.uint8)
    window = int(WINDOW * SCALE) + 1
    a, b, line = steps(own[mine]) + np.uint8(window), np.ascontiguousarray(steps(others[theirs]).T), others[theirs, 0]
    half = LINES // 2
    xs, ys = [], []
    for i in range(0, len(mine), 128):
        part = a[i : i + 128]
        places = own[mine[i : i + 128], 0]
        lo, hi = np.searchsorted(line, places[0] - reach, side="left"), np.searchsorted(line, places[-1] + reach, side="right")
        met = np.zeros((len(part), hi - lo), dtype=np.uint8)
        for k in range(half):
            met += (part[:, k, None] - b[k, lo:hi]) <= 2 * window
        x, y = np.nonzero(met >= need - (LINES - half))
        count = met[x, y]
        y += lo
        for k in range(half, LINES):
            count += (part[x, k] - b[k, y]) <= 2 * window
        xs.append(mine[i + x[count >= need]])
        ys.append(theirs[y[count >= need]])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compare(rows: pa.Table, need: int) -> pa.Table:
    """Link counts and a spanning forest of one pair of blocks: rows (a, b, n); b null for a count."""
    rows = rows.sort_by([("side", "ascending"), ("cls", "ascending")]).combine_chunks()
    column = lambda name: rows.column(name).to_numpy()
    units = unit(matrix(rows.column("vector")))
    cls, copies, side = column("cls"), column("copies"), column("side")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = column("i")[0] == column("j")[0]
    right = left if within else right
    places = units @ _random(units.shape[1], LINES, 0)
    x, y = collided(places[left], places[right], need)
    x, y = left[x], right[y]
    if within:
        x, y = x[x < y], y[x < y]
    if int(column("table")[0]):
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        fresh = ~(codes[x] == codes[y]).any(axis=1)
        x, y = x[fresh], y[fresh]
    near = np.concatenate([np.einsum("ij,ij->i", units[x[k : k + 16_384]], units[y[k : k + 16_384]]) >= THRESHOLD for k in range(0, len(x), 16_384)]) if len(x) else np.zeros(0, dtype=bool)
    x, y = x[near], y[near]
    counts = (np.bincount(x, copies[y], len(cls)) + np.bincount(y, copies[x], len(cls))).astype(np.int64)
    tree = _forest(len(cls), x, y)
    some = np.flatnonzero(counts)
    return pa.table({"a": np.concatenate([cls[some], cls[[t[0] for t in tree]]]).astype(np.int64), "b": pa.array([None] * len(some) + [int(cls[t[1]]) for t in tree], pa.int64()), "n": np.concatenate([counts[some], np.zeros(len(tree), np.int64)])})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    classes = saved(classes_of(vectors), "vector-classes")
    need = collision_count()
    dealt = saved(cells(classes), "cells")
    found = saved(blocks(dealt).groupBy("table", "cell", "i", "j").applyInArrow(lambda rows: compare(rows, need), "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    labels = components(found.where("b is not null").select("a", "b"))
    named = (
        classes.withColumnRenamed("label", "name")
        .join(counts, F.col("cls") == F.col("a"), "left")
        .join(labels, F.col("cls") == F.col("node"), "left")
        .select("name", "vector", "copies", "low", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("label", "cls").alias("group"))
    )
    lows = named.groupBy("group").agg(F.min("low").alias("component_id"))
    result = named.join(lows, "group").select("name", "vector", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    ok = usable(F.col("embedding")) & F.col("label").isNotNull()
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.col("label").cast("string")).alias("name"), F.when(ok, _numbers(vectors)).alias("vector"), ok.alias("ok"))
    inside = all_rows.where("ok").join(result, ["name", "vector"]).select("vec_id", "n_links", "component_id")
    alone = all_rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
