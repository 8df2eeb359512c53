"""Operator 2, quality classifier: random Fourier features over document statistics, ridge by normal equations summed
over partitions, isotonic calibration.

The statistics describe the whole text (lengths, character classes, repetition); labels, lang, source and doc_id are
never among them. They are standardised on the training rows, and ``FEATURES`` random cosines approximate a Gaussian
kernel on them. Each partition sums its rows' normal equations for every fold; the sums are added up in a tree, so the
driver holds one small set of matrices however many rows there are. Solutions without a fold come from the difference
of sums and give honest scores for the choice of the ridge and for calibration, which pools adjacent violators over a
fixed grid of score bins.

All labelled rows whose crc32(doc_id as text) mod 3 is not 1 are trained on (no sampling).

Defined results: null text is scored as empty text; a null doc_id is scored, is not held out and has no label; repeated
rows are scored alike; several labels of a document all count, null labels don't; without any training label every
score is 0.5; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, table
from .tokens import slices
from .words import Words

FEATURES, FOLDS, SEED = 256, 5, 20_240_602
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
BINS, LOW, HIGH = 1000, -0.5, 1.5
#: Share of the raw score in the result: it orders rows that calibration ties.
BLEND = 0.01

NAMES = ("words", "bytes", "word_length", "word_length_spread", "upper", "digits", "stops", "shouts", "symbols", "wide", "blanks", "lines", "repeats", "distinct", "shingle_copies", "top_word")
_CLASS = np.zeros(256, dtype=np.int64)
for _c, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?", "#$%&*+/<=>@[\\]^_`{|}~", "", " \t\v\f\r", "\n"), 1):
    _CLASS[[ord(x) for x in _chars]] = _c
_CLASS[128:] = 6


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    words = Words(texts)
    sizes, counts = np.diff(words.offsets), np.diff(words.bounds)
    n = len(sizes)
    kinds = np.bincount(np.repeat(np.arange(n) * 9, sizes) + _CLASS[words.raw], minlength=n * 9).reshape(n, 9) / np.maximum(sizes, 1)[:, None]
    lengths = (words.end - words.start).astype(np.float64)
    owner = np.repeat(np.arange(n), counts)
    per = np.maximum(counts, 1)
    mean = np.bincount(owner, lengths, n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths**2, n) / per - mean**2, 0))
    names = words.hashes()
    same = np.zeros(len(names))
    if len(names) > 1:
        same[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, n) / per
    distinct, top = np.ones(n), np.zeros(n)
    for i, (lo, hi) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        if hi > lo:
            each = np.unique(names[lo:hi], return_counts=True)[1]
            distinct[i] = np.log1p(len(each)) / np.log1p(hi - lo)
            top[i] = each.max() / (hi - lo)
    sets = np.array([len(s) for s in words.shingle_sets()], dtype=np.float64)
    copies = 1 - sets / np.maximum(np.where(counts >= 5, counts - 4, counts > 0), 1)
    copies[counts == 0] = 0
    lines = np.log1p(kinds[:, 8] * 100)
    return np.stack([np.log1p(counts), np.log1p(sizes), np.log1p(mean), np.log1p(spread), *(np.sqrt(kinds[:, c]) for c in (1, 2, 3, 4, 5, 6, 7)), lines, repeats, distinct, copies, top], axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x array<float>, tag): tag tells texts of one doc_id apart."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=1000, chars=1_000_000):
                x = statistics(part.column(3)).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["doc_id", "held_out", "tag", "x"])

    doc = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(run, "doc_id long, held_out boolean, tag long, x array<float>")


def summed(df: DataFrame, part, size: int) -> np.ndarray:
    """``part(batch) -> float64 array`` summed over the batches of each partition, then over partitions in a tree."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(run, "sum binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    return sums.treeReduce(lambda a, b: a + b, depth=2)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Model:
    """Fitted scorer; small, so it travels with the task."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.waves = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(2.0 * len(mean)) * 2.0
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z @ self.waves + self.shift), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        raw = self.lift(x) @ self.weights
        return np.clip((1 - BLEND) * np.interp(raw, *self.knots) + BLEND * np.clip(raw, 0, 1), 0, 1)


def isotonic(places: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (place, probability) of the best non-decreasing fit, at block centres."""
    blocks: list[list[float]] = []
    for x, h, c in zip(places, hits, counts, strict=True):
        blocks.append([x * c, h, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame) -> Model:
    """From (x, y double, fold int)."""
    dims = len(NAMES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    got = summed(train.select("x"), moments, 1 + 2 * dims)
    n = got[0]
    mean = got[1 : 1 + dims] / max(n, 1)
    model = Model(mean, np.sqrt(np.maximum(got[1 + dims :] / max(n, 1) - mean**2, 0)))
    if not n:
        return model
    width = FEATURES + 1
    shape = (FOLDS, width + 1, width + 1)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        full = np.hstack([model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        fold = batch.column(2).to_numpy(zero_copy_only=False)
        return np.stack([full[fold == k].T @ full[fold == k] for k in range(FOLDS)]).ravel()

    sums = summed(train.select("x", "y", "fold"), normal, int(np.prod(shape))).reshape(shape)
    whole = sums.sum(0)

    def solve(m: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.full(width, ridge * max(m[width - 1, width - 1], 1.0) / FEATURES)
        penalty[-1] = 1e-9 * max(n, 1.0)
        return np.linalg.solve(m[:width, :width] + np.diag(penalty), m[:width, width])

    def missed(m: np.ndarray, w: np.ndarray) -> float:
        v = np.append(w, -1.0)
        return float(v @ m @ v)

    errors = {r: sum(missed(sums[k], solve(whole - sums[k], r)) for k in range(FOLDS)) for r in RIDGES}
    ridge = min(errors, key=errors.get)
    others = np.stack([solve(whole - sums[k], ridge) for k in range(FOLDS)])
    model.weights = solve(whole, ridge)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw = (model.lift(_matrix(batch.column(0))) * others[batch.column(2).to_numpy(zero_copy_only=False)]).sum(1)
        at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), BINS), np.bincount(at, raw, BINS)])

    counts, hits, raws = summed(train.select("x", "y", "fold"), binned, 3 * BINS).reshape(3, BINS)
    seen = counts > 0
    model.knots = isotonic(raws[seen] / counts[seen], hits[seen], counts[seen])
    return model


def trained(rows: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return fit(saved(rows.where(~F.col("held_out")).join(known, "doc_id").select("x", "y", fold.alias("fold")), "train"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, tag) for every row of ``docs``."""
    rows = saved(described(docs), "statistics")
    model = trained(rows, labels)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column(3))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column(2)], names=["doc_id", "held_out", "score", "predicted", "tag"])

    return rows.select("doc_id", "held_out", "tag", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, tag long")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns unchanged."""
    own_id, own_tag = free_name("id"), free_name("tag")
    bad = classify(docs, labels).where("predicted = 0").select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag)).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(own_tag))
    return docs.join(bad, match, "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tag")
