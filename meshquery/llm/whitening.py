"""Operator 11, embedding whitening by digit-slice products.

Entries become whole numbers x; everything up to the covariance is exact. The rows n*x - S (n distinct vectors of sums
S) are centred whole numbers; cut into digits of 20 bits, their products over 4096 rows stay below 2^53, so BLAS in
doubles gives them without rounding. Digit planes are carried, merged over partitions, put together as big integers and
only then decomposed: ``eigh`` proposes directions, the exact product of those directions with the exact covariance
gives a nearly diagonal matrix, and Jacobi rotations on it make small variances as exact, relatively, as large ones.

Plan: distinct vectors are written once (one shuffle; copies collapse before it); counts and sums, products, and the
check of the result are three passes over that table, each merged from one small row per task; the rows themselves are
whitened without a shuffle. A fit travels to the tasks by value while all vector lengths together stay below
``FIT_WIDTH`` entries; beyond that blocks of 4096 rows are joined with their fit.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; a repeated row is whitened
each time and fitted once; ids may be null or repeated; every vector length has a fit of its own, and identity_error is
the largest of all lengths. Directions without variance are no components: a length with one distinct vector, or an
empty vector, gives no rows. Entries that overflow a long count as its limits. An empty table gives no rows; further
columns are ignored. A deviation of more than 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import saved, table

SCALE, OFFSET, MOST = 64, 1_000_000, 16
DIGIT, BLOCK = 20, 4096  # 2 * 20 + 12 bits are exact in a double
MASK = (1 << DIGIT) - 1
FIT_WIDTH = 1 << 18
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
PRIMES = (2_147_483_647, 2_147_483_629)
FITS = "width int, n long, sums array<string>, components array<array<double>>, variances array<double>, explained array<double>"
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def digits(z: np.ndarray) -> list[np.ndarray]:
    """Planes of 20-bit digits, lowest first; the last one keeps the sign. ``z``: int64, or Python integers."""
    planes = []
    while ((z > MASK) | (z < -MASK)).any():
        planes.append(z & MASK)
        z = z >> DIGIT
    return [p.astype(np.int64) for p in [*planes, z]]


def carried(planes: list[np.ndarray]) -> list[np.ndarray]:
    """The same number with digits of 20 bits, and one last plane of 0 and -1."""
    out, carry = [], np.zeros_like(planes[0])
    for plane in planes:
        plane = plane + carry
        out.append(plane & MASK)
        carry = plane >> DIGIT
    while ((carry != 0) & (carry != -1)).any():
        out.append(carry & MASK)
        carry = carry >> DIGIT
    return [*out, carry]


def added(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    if a is None:
        return carried(b)
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return carried([p + short[i] if i < len(short) else p for i, p in enumerate(long)])


def whole(planes: list[np.ndarray]) -> np.ndarray:
    """Python integers."""
    return sum(p.astype(object) << (DIGIT * i) for i, p in enumerate(planes))


def product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Planes of A^T B for digit planes of A and B with at most BLOCK rows: BLAS on doubles, none of which rounds."""
    fa, fb = [p.astype(np.float64) for p in a], [p.astype(np.float64) for p in b]
    planes = [np.zeros((a[0].shape[1], b[0].shape[1]), dtype=np.int64) for _ in range(len(a) + len(b) - 1)]
    for i, left in enumerate(fa):
        for j, right in enumerate(fb):
            planes[i + j] += (left.T @ right).astype(np.int64)
    return planes


def product_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A^T B of whole-number matrices, exactly."""
    total = None
    for at in range(0, len(a), BLOCK):
        total = added(total, product(digits(a[at : at + BLOCK]), digits(b[at : at + BLOCK])))
    return whole(total)


def rank(c: np.ndarray) -> int:
    """Rank of a matrix of Python integers, by elimination modulo two primes (never too high)."""
    found = 0
    for prime in PRIMES:
        m, row = (c % prime).astype(np.int64), 0
        for column in range(m.shape[1]):
            pivots = np.flatnonzero(m[row:, column])
            if not len(pivots):
                continue
            m[[row, row + pivots[0]]] = m[[row + pivots[0], row]]
            m[row] = m[row] * pow(int(m[row, column]), -1, prime) % prime
            m[row + 1 :] = (m[row + 1 :] - m[row + 1 :, column, None] * m[row] % prime) % prime
            row += 1
            if row == len(m):
                break
        found = max(found, row)
    return found


def eigen(c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (rows) of the symmetric matrix of Python integers with the largest eigenvalues, and those; at most
    ``most``, none of eigenvalue 0. The largest entry of each is positive."""
    count = min(most, rank(c))
    if not count:
        return np.zeros((0, len(c))), np.zeros(0)
    _, q = np.linalg.eigh(c.astype(np.float64))
    steps = np.rint(q[:, ::-1] * 2.0**52).astype(np.int64).astype(object)
    t = product_of(steps, product_of(c, steps)).astype(np.float64)
    q = steps.astype(np.float64)
    for _ in range(30):
        size = np.sqrt(np.maximum(np.diag(t), 0.0))
        off = np.abs(np.triu(t, 1)) > 1e-14 * size[:, None] * size
        off[:, size == 0] = off[size == 0] = False
        pairs = np.argwhere(off[:count])
        if not len(pairs):
            break
        for i, j in pairs:
            if t[i, j] == 0.0:
                continue
            tau = (t[j, j] - t[i, i]) / (2.0 * t[i, j])
            tan = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
            cos = 1.0 / np.hypot(1.0, tan)
            turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
            t[:, [i, j]] = t[:, [i, j]] @ turn
            t[[i, j]] = turn.T @ t[[i, j]]
            q[:, [i, j]] = q[:, [i, j]] @ turn
    norm = np.linalg.norm(q, axis=0)
    values, vectors = np.diag(t) / norm**2, (q / norm).T
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[order], vectors[order]
    signs = np.sign(vectors[np.arange(count), np.abs(vectors).argmax(axis=1)])
    return vectors * signs[:, None], values


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's rows of each vector length, BLOCK at most at a time."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        part = batch if (widths == width).all() else batch.filter(pa.array(widths == width))
        for at in range(0, part.num_rows, BLOCK):
            yield width, part.slice(at, BLOCK)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: int64 where that can't overflow, else Python integers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums), default=0)
    if largest <= LONG_MAX:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def whole_numbers(vectors: DataFrame, *kept: str, vector_col: str = "embedding") -> DataFrame:
    """(kept.., width, x array<long>) of the rows whose vector has neither null nor non-finite entries."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    each = F.transform(vector, lambda c: F.least(F.floor(c * SCALE).cast("long"), F.lit(LONG_MAX - OFFSET)) + OFFSET)
    return vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)).select(*kept, F.size(vector).alias("width"), each.alias("x"))


def with_fits(rows: DataFrame, fits: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run({width: fit}, batches)`` over rows (width, ..). Fits go by value below FIT_WIDTH entries, else to blocks of rows."""
    if (fits.agg(F.sum("width")).first()[0] or 0) <= FIT_WIDTH:
        known = {f.width: f.asDict() for f in fits.collect()}
        return rows.mapInArrow(lambda batches: run(known, batches), schema)
    blocks = saved(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), 12)), "whitening-blocks")
    own = saved(blocks.select("width", "block").distinct().join(fits, "width"), "whitening-block-fits")

    form = to_arrow_schema(StructType.fromDDL(schema))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [b.cast(form) for b in run({f["width"]: f for f in right.to_pylist()}, left.drop_columns(["block"]).to_batches())]
        return pa.Table.from_batches(out, form)

    return blocks.groupBy("width", "block").cogroup(own.groupBy("width", "block")).applyInArrow(meet, schema)


def _blob(planes: list[np.ndarray]) -> bytes:
    return np.stack(planes).astype("<i8").tobytes()


def _planes(blob: bytes, width: int) -> list[np.ndarray]:
    return list(np.frombuffer(blob, dtype="<i8").reshape(-1, width))


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of (width, place, n, planes) for a group's."""
    total, n, width, place = None, 0, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            width, place, n = row["width"], row["place"], n + row["n"]
            total = added(total, _planes(row["planes"], width))
    yield pa.RecordBatch.from_pylist([{"width": width, "place": place, "n": n, "planes": _blob(total)}], schema=PARTIAL_ARROW)


PARTIAL = "width int, place int, n long, planes binary"
PARTIAL_ARROW = pa.schema([("width", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("planes", pa.binary())])


def sums_of(distinct: DataFrame) -> DataFrame:
    """(width, n, sums): how many vectors of a length, and the sum of each entry as text."""

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for width, part in _by_width(batch):
                x = _matrix(part.column("x"), width)
                held = totals.setdefault(width, [0, None])
                held[0] += len(x)
                held[1] = added(held[1], [p.sum(axis=0) for p in digits(x)])
        yield pa.RecordBatch.from_pylist([{"width": w, "place": 0, "n": n, "planes": _blob(planes)} for w, (n, planes) in totals.items()], schema=PARTIAL_ARROW)

    def told(batches):
        for batch in batches:
            rows = [{"width": r["width"], "n": r["n"], "sums": [str(v) for v in whole(_planes(r["planes"], r["width"]))]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    return distinct.mapInArrow(run, PARTIAL).groupBy("width").applyInArrow(_sum_blobs, PARTIAL).mapInArrow(told, "width int, n long, sums array<string>")


def _products(fits: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sum of (n*x - S)(n*x - S)^T, a row of digit planes for each row of the matrix."""
    totals: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for width, part in _by_width(batch):
            fit = fits[width]
            z = digits(centred(_matrix(part.column("x"), width), fit["n"], [int(s) for s in fit["sums"]]))
            totals[width] = added(totals.get(width), product(z, z))
    for width, planes in totals.items():
        rows = np.stack(planes)
        yield pa.RecordBatch.from_pylist([{"width": width, "place": i, "n": 0, "planes": rows[:, i].astype("<i8").tobytes()} for i in range(width)], schema=PARTIAL_ARROW)


def fit(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """FITS: a row per vector length, from the distinct vectors (width, x) of ``whole_numbers``."""
    sums = saved(sums_of(distinct), "whitening-sums")
    rows = with_fits(distinct, sums, _products, PARTIAL).groupBy("width", "place").applyInArrow(_sum_blobs, PARTIAL)

    def decompose(pdf):
        import pandas as pd

        width, n = int(pdf["width"].iloc[0]), int(pdf["n"].iloc[0])
        by_row = pdf.sort_values("place")["planes"]
        c = np.stack([whole(_planes(b, width)) for b in by_row])
        vectors, values = eigen(c, most)
        variances, explained = values / float(n**3), values / float(sum(np.diag(c))) if len(values) else values
        return pd.DataFrame({"width": [width], "components": [vectors.tolist()], "variances": [variances.tolist()], "explained": [explained.tolist()]})

    counted = rows.drop("n").join(sums.select("width", "n"), "width")
    found = counted.groupBy("width").applyInPandas(decompose, "width int, components array<array<double>>, variances array<double>, explained array<double>")
    return saved(sums.join(found, "width").select(*[f.split()[0] for f in FITS.split(", ")]), "whitening-fits")


def _projected(fit: dict, z: np.ndarray) -> np.ndarray:
    return (z.astype(np.float64) / fit["n"]) @ np.array(fit["components"]).T / np.sqrt(np.array(fit["variances"]))


def _moments(fits: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, means and centred products of whitened rows, per partition and length."""
    held: dict[int, tuple] = {}
    for batch in batches:
        for width, part in _by_width(batch):
            fit = fits[width]
            if len(fit["variances"]):
                y = _projected(fit, centred(_matrix(part.column("x"), width), fit["n"], [int(s) for s in fit["sums"]]))
                mean = y.mean(axis=0)
                held[width] = merged(held.get(width), (len(y), mean, (y - mean).T @ (y - mean)))
    rows = [{"width": w, "n": n, "means": mean.tolist(), "products": products.ravel().tolist()} for w, (n, mean, products) in held.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=MOMENTS_ARROW)


MOMENTS = "width int, n long, means array<double>, products array<double>"
MOMENTS_ARROW = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("means", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def merged(a: tuple | None, b: tuple) -> tuple:
    """Centred moments of two sets of rows as one."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(distinct: DataFrame, fits: DataFrame) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; null without components."""

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                mean = np.array(row["means"])
                total = merged(total, (row["n"], mean, np.array(row["products"]).reshape(len(mean), -1)))
        yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(total[2] / total[0] - np.eye(len(total[1]))).max())])], names=["error"])

    return with_fits(distinct, fits, _moments, MOMENTS).groupBy("width").applyInArrow(error, "error double").agg(F.max("error")).first()[0]


def _whitened(fits: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for width, part in _by_width(batch):
            fit = fits[width]
            count = len(fit["variances"])
            if not count:
                continue
            z = centred(_matrix(part.column("x"), width), fit["n"], [int(s) for s in fit["sums"]])
            planes = digits(z)
            squares = [np.zeros(len(z), dtype=np.int64) for _ in range(2 * len(planes) - 1)]
            for i, a in enumerate(planes):
                for j, b in enumerate(planes):
                    squares[i + j] += (a * b).sum(axis=1)
            deviation = whole(carried(squares)).tolist()
            told = pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(z)), count))
            columns = [
                part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))), pa.array(np.full(len(row), fit["n"])),
                told.take(row), pa.array(_projected(fit, z).ravel()), pa.array(np.tile(np.array(fit["explained"]), len(z))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WHITENED.split(", ")])


def whiten(vectors: DataFrame, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """WHITENED and identity_error: a row for every usable row of ``vectors`` and each of its ``most`` first components."""
    rows = whole_numbers(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), "vec_id", vector_col="vector")
    distinct = saved(rows.select("width", "x").distinct(), "whitening-distinct")
    fits = fit(distinct, most)
    error = identity_error(distinct, fits)
    return with_fits(rows, fits, _whitened, WHITENED).withColumn("identity_error", F.lit(error).cast("double"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
