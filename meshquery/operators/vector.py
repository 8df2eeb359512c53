"""Vector operators: cosine, top-k, merging of feature vectors, pixel differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FEATURE_DIM

SAME = 0.95


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine in double precision; ``zero`` for zero vectors, 0 for empty ones or unequal lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).when(size == 0, zero).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def _fast_cosine(target: list[float]):
    """Cosine with one fixed vector on Arrow batches; for scans of many rows."""
    fixed = np.asarray(target, dtype=np.float64)
    size = np.linalg.norm(fixed)

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
        fit = np.flatnonzero(sizes == len(fixed))
        out = np.full(len(sizes), np.nan)
        if len(fit):
            rows = col.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
            own = np.linalg.norm(rows, axis=1) * size
            out[fit] = np.divide(rows @ fixed, own, out=np.full(len(fit), -1.0), where=own > 0)
        return pa.array(out)

    return score


def nearest(rows: DataFrame, target: list[float], k: int, vector: str = "features", ties: tuple[str, ...] = ("domain", "node_id"), least: float | None = None) -> DataFrame:
    """The k rows most like ``target``, as ``similarity``; a zero target has none, a zero row counts -1. Per-task top-k
    before the one final merge (TakeOrderedAndProject); the vectors themselves never move."""
    if not any(target):
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    scored = rows.withColumn("similarity", _fast_cosine(target)(F.col(vector))).where(~F.isnan("similarity"))
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), *ties).limit(k)


def similar_to(rows: DataFrame, key: str, value, k: int, vector: str = "features", least: float | None = None) -> DataFrame:
    """The k rows most like the row whose ``key`` is ``value``, without itself."""
    own = rows.where(F.col(key) == value).select(vector).first()
    if own is None:
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    return nearest(rows.where(F.col(key) != value), list(own[0]), k, vector, (key,), least)


def compare(rows: DataFrame, key: str, a, b, vector: str = "embedding") -> DataFrame:
    """One row (a, b, similarity, is_same) for two rows."""
    left = rows.where(F.col(key) == a).select(F.col(key).alias("a"), F.col(vector).alias("_a"))
    right = rows.where(F.col(key) == b).select(F.col(key).alias("b"), F.col(vector).alias("_b"))
    joined = left.join(right, F.lit(True))  # one row each
    return joined.select("a", "b", cosine(F.col("_a"), F.col("_b")).alias("similarity")).withColumn("is_same", F.col("similarity") > SAME)


def merged_features(rendered: Column, static: Column, rendered_score: Column, static_score: Column) -> Column:
    """Dimension by dimension: the only known value, or that of the more complete source (the static one on ties)."""
    def one(i: Column) -> Column:
        a, b = F.nullif(F.get(rendered, i), F.lit(0.0)), F.nullif(F.get(static, i), F.lit(0.0))
        return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.when(static_score >= rendered_score, b).otherwise(a)), a, b, F.lit(0.0)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(FEATURE_DIM - 1)), one)


# Fixed values of the pixel comparison.
STEP, GRID, SHARE, LEAST_SIDE = 30, 8, 10, 10


def pixel_diff(a: np.ndarray, b: np.ndarray) -> tuple[float, float, list[tuple[int, int, int, int]]]:
    """(similarity, changed share, regions) of two grey images, cut to their common size by nearest sampling. Regions are joined
    cells of an eighth of each side, at least ten wide, of which over a tenth changed."""
    h, w = min(len(a), len(b)), min(a.shape[1], b.shape[1])

    def fit(x: np.ndarray) -> np.ndarray:
        return x[np.arange(h) * len(x) // h][:, np.arange(w) * x.shape[1] // w].astype(np.int32)

    if not h or not w:
        return 1.0, 0.0, []
    moved = np.abs(fit(a) - fit(b)) > STEP
    share = float(moved.mean())
    boxes = []
    tall, wide = max(h // GRID, 1), max(w // GRID, 1)  # whole cells only; what is left over at the far sides has none
    for top in range(0, h - tall + 1, tall):
        for left in range(0, w - wide + 1, wide):
            if wide >= LEAST_SIDE and moved[top : top + tall, left : left + wide].sum() > tall * wide // SHARE:
                boxes.append([left, top, left + wide, top + tall])
    joined = True
    while joined:  # touching boxes grow together
        joined = False
        for x in range(len(boxes)):
            for y in range(x + 1, len(boxes)):
                p, q = boxes[x], boxes[y]
                if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]:
                    boxes[x] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                    del boxes[y]
                    joined = True
                    break
            if joined:
                break
    return 1.0 - share, share, [(p[0], p[1], p[2] - p[0], p[3] - p[1]) for p in boxes]


def image_diffs(pairs: DataFrame) -> DataFrame:
    """(key, similarity, changed, regions) of rows (key, a, b): a and b are grey images as arrays of rows."""

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField("key", pairs.schema["key"].dataType), *StructType.fromDDL("similarity double, changed double, regions array<struct<x:int,y:int,width:int,height:int>>").fields])
    arrow = to_arrow_schema(schema)

    def images(lists: pa.ListArray):
        """The images of a column without a Python object per row: slices of its flat values."""
        starts, rows = lists.offsets.to_numpy(), lists.values
        cells, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if len(widths := set(np.diff(cells[i : j + 1]).tolist())) > 1:
                raise ValueError("the rows of an image have one length")
            yield values[cells[i] : cells[j]].reshape(j - i, widths.pop() if widths else 0)

    def run(batches):
        for batch in batches:
            got = [pixel_diff(a, b) for a, b in zip(images(batch.column("a")), images(batch.column("b")), strict=True)]
            regions = [[{"x": r[0], "y": r[1], "width": r[2], "height": r[3]} for r in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(x, arrow.field(n).type) for n, x in (("similarity", [g[0] for g in got]), ("changed", [g[1] for g in got]), ("regions", regions))]], schema=arrow)

    return pairs.select("key", "a", "b").mapInArrow(run, schema)
