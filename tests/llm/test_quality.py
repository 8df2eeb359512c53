import zlib

import numpy as np
import pyarrow as pa

from meshquery.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, x string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "clash") for i, t in rows], DOCS)


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "stream", "river", "stone", "cloud", "leaf"]
    texts, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        body = list(rng.choice(words, int(rng.integers(20, 90))))
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 2 else [w for w in body[:6] for _ in range(12)]
        texts.append((i, " ".join(body) + "."))
        labels.append((i, int(good), 0))
    return texts, labels


def test_held_out_accuracy_on_the_given_table(spark):
    out = quality.op2(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    texts, labels = made(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    one, two = (quality.classify(docs(spark, texts), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert np.allclose(one, two)


def test_odd_rows(spark):
    texts, labels = made(240)
    texts += [(1000, None), (1001, ""), (1002, " \n "), (None, "no id here"), (7, texts[7][1]), (1003, "word " * 60_000)]
    labels += [(5, None, 0), (None, 1, 0), (8, 1, 0)]
    out = quality.classify(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == len(texts) and out.score.notna().all()
    assert out[out.doc_id.isna()].held_out.tolist() == [False]
    assert out[out.doc_id == 7].score.nunique() == 1
    kept = quality.accepted(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert kept.count() == (out.predicted == 1).sum()


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs(spark, []), none).count() == 0
    assert {r.score for r in quality.classify(docs(spark, [(1, "a b c"), (2, None)]), none).collect()} == {0.5}


def test_isotonic_is_the_best_monotone_fit():
    x, y = quality.isotonic(np.arange(6.0), np.array([1.0, 0.0, 1.0, 3.0, 2.0, 4.0]), np.array([2.0, 2.0, 2.0, 4.0, 4.0, 4.0]))
    assert (np.diff(y) > 0).all()
    assert np.allclose(y, [1 / 4, 1 / 2, 5 / 8, 1.0])


def test_statistics_see_the_whole_text():
    head = "plain words here and there. " * 400
    a, b = quality.statistics(pa.array([head, head + "SHOUT!! " * 4000]))
    assert not np.allclose(a, b) and len(a) == len(quality.NAMES)


def test_scores_against_dense_ridge_and_isotonic_fits(spark):
    """The same features, folds and labels, solved as one dense least-squares problem and by a plain isotonic fit."""
    texts, labels = made(600)
    flips = np.random.default_rng(8).random(600) < 0.15  # so that calibration has something to do
    labels = [(i, y ^ int(f), 0) for (i, y, _), f in zip(labels, flips, strict=True)]
    frame, known = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame, known).toPandas().set_index("doc_id").sort_index()
    rows = quality.described(frame).toPandas().set_index("doc_id").sort_index()
    x = np.stack(rows.x)
    fold = frame.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) AS fold").toPandas().set_index("doc_id").sort_index().fold.to_numpy()
    y = np.array([l[1] for l in sorted(labels)], dtype=float)
    train = ~rows.held_out.to_numpy()
    assert (rows.held_out.to_numpy() == np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.index])).all()
    model = quality.Model(x[train].mean(0), x[train].std(0))
    lifted = model.lift(x)

    def solve(keep, ridge):
        n = keep.sum()
        root = np.sqrt(np.append(np.full(quality.FEATURES, ridge * max(n, 1) / quality.FEATURES), 1e-9 * max(train.sum(), 1)))
        return np.linalg.lstsq(np.vstack([lifted[keep], np.diag(root)]), np.append(y[keep], np.zeros(len(root))), rcond=None)[0]

    folds = [train & (fold == k) for k in range(quality.FOLDS)]
    error = {r: sum(((lifted[f] @ solve(train & ~f, r) - y[f]) ** 2).sum() for f in folds) for r in quality.RIDGES}
    ridge = min(error, key=error.get)
    raw = np.zeros(len(y))
    for f in folds:
        raw[f] = lifted[f] @ solve(train & ~f, ridge)
    bins = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    seen = sorted(set(bins[train]))
    places = [raw[train & (bins == b)].mean() for b in seen]
    # Isotonic fit at each bin: the largest over starts of the least over ends of the mean hit rate between them.
    hits, counts = np.array([y[train & (bins == b)].sum() for b in seen]), np.array([(train & (bins == b)).sum() for b in seen])
    h, c = np.concatenate([[0], np.cumsum(hits)]), np.concatenate([[0], np.cumsum(counts)])
    fit = np.array([max(min((h[b] - h[a]) / (c[b] - c[a]) for b in range(i + 1, len(seen) + 1)) for a in range(i + 1)) for i in range(len(seen))])
    blocks = [np.flatnonzero(np.isclose(fit, v)) for v in sorted(set(np.round(fit, 12)))]
    knots = [np.average(np.array(places)[b], weights=counts[b]) for b in blocks], [np.average(fit[b], weights=counts[b]) for b in blocks]
    final = lifted @ solve(train, ridge)
    want = np.clip((1 - quality.BLEND) * np.interp(final, *knots) + quality.BLEND * np.clip(final, 0, 1), 0, 1)
    assert np.allclose(got.score.to_numpy(), want, atol=1e-5)
