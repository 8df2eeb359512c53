import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshquery.llm import additive, collisions

ROWS = "vec_id long, embedding array<float>, label int, vector string, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "clash", 3) for i, v, l in rows], ROWS)


def clustered(n, wide=16, groups=12, noise=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, wide))
    out = []
    for i in range(n):
        v = centres[rng.integers(groups)] + noise * rng.standard_normal(wide) * rng.integers(0, 6) if i % 3 else rng.standard_normal(wide)
        out.append((i, np.float32(v * rng.uniform(0.1, 9)).tolist(), int(i % 2)))
    return out


ODD = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [None] + [1.0] * 15, 0), (906, [1.0] * 16, None), (907, [1.0] * 15, 0), (908, [3e38] * 16, 0), (909, [1e-40] * 16, 0), (910, [2.0] * 15, 0)]


def brute(rows):
    ok = [(k, i, np.array(v, dtype=np.float64), l) for k, (i, v, l) in enumerate(rows) if v and l is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) for x in v)]
    ok = [(k, i, v / np.abs(v).max(), l) for k, i, v, l in ok]
    ok = [(k, i, v / np.linalg.norm(v), l) for k, i, v, l in ok]
    links, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (k, _, v, l), (m, _, w, o) = ok[a], ok[b]
            if l == o and len(v) == len(w) and v @ w >= 0.98:
                links[k] += 1
                links[m] += 1
                p, q = root(k), root(m)
                up[max(p, q)] = min(p, q)
    low = {}
    for k, (i, *_) in enumerate(rows):
        low[root(k)] = min([x for x in (low.get(root(k)), i) if x is not None], default=None)
    return sorted(((i, links[k], low[root(k)], i == low[root(k)]) for k, (i, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell", [512, 24])
def test_near_duplicates_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(collisions, "CELL", cell)
    rows = clustered(400) + ODD + [(i, clustered(3)[1][1], 0) for i in range(700, 760)] + [(700, clustered(3)[1][1], 0), (None, clustered(3)[1][1], 0), (None, [1.0, -1.0] * 8, 1)]
    got = sorted((tuple(r) for r in collisions.near_duplicates(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)


def test_no_vectors(spark):
    assert collisions.near_duplicates(frame(spark, [])).count() == 0
    assert additive.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert additive.search(frame(spark, ODD[:6]), F.col("vec_id") % 50 == 0).count() == 0


def test_pair_of_blocks_counts_each_pair_once():
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    pdf = pd.DataFrame({"table": 0, "cell": 0, "i": 0, "j": 1, "side": [0] * 30 + [1] * 20, "cls": range(50), "copies": 1, "vector": [base + 0.01 * rng.standard_normal(16) for _ in range(50)], "codes": [np.zeros(1, dtype=np.int64)] * 50})
    out = collisions.compare(pa.Table.from_pandas(pdf), collisions.collision_count()).to_pandas()
    counts = out[out.b.isna()].set_index("a").n
    assert counts[0] == 20 and counts[49] == 30 and out.b.notna().sum() == 49


def test_recall_parameters():
    assert collisions.collision_count() == 20 and collisions.tables_for(0) == 1
    assert collisions.tables_for(3) > collisions.tables_for(1)


def nearest(rows, k=5):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) for x in v):
            w = np.float32(v).astype(np.float64)
            w = w / np.abs(w).max()
            ok[i] = w / np.linalg.norm(w)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 50 == 0]:
        s = np.round(x @ ok[q], 13)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(q)] = list(zip(ids[keep][order].tolist(), s[keep][order], strict=True))
    return out


def test_search_against_brute_force(spark):
    rows = clustered(1500, groups=30, noise=0.1) + [(i + 1000, v, l) for i, v, l in ODD] + [(i, clustered(3)[1][1], 0) for i in range(5000, 5120)]
    got = {}
    for r in additive.search(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = nearest(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    copies = [q for q in got if 5000 <= q < 5120]
    assert copies and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in copies)


def test_search_with_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 2), (2, [1.0, 1.0], 2)]
    assert [(r.query_id, r.rank, r.vec_id) for r in additive.search(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16 if i % 3 else 8).tolist(), 0) for i in range(400)] + [(1001, [1.0], 0), (1000, [-3.0], 0)]
    got = {}
    for r in additive.search(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    vectors = {i: np.float32(v).astype(np.float64) / np.linalg.norm(np.float32(v)) for i, v, _ in rows}
    for q in (i for i, _, _ in rows if i % 50 == 0):
        near = sorted((-vectors[q] @ v, i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
        assert got[q] == [i for _, i in near]


def recalled(spark, rows):
    """Share of the true five nearest that a search over (vec_id, vector) finds, and the search's rows."""
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows]).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"vec_id": ids, "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
    got = additive.search(spark.createDataFrame(table), F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    asked = np.flatnonzero(ids % 50 == 0)
    x = x.astype(np.float32).astype(np.float64)
    scores = (x[asked] @ x.T) / np.linalg.norm(x, axis=1)
    scores[np.arange(len(asked)), asked] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    return sum(len(set(ids[b]) & got[ids[q]]) for q, b in zip(asked, best, strict=True)) / (5 * len(asked))


def test_recall_where_few_rows_are_reranked(spark):
    # 20 000 rows in blocks of 4096, of which a block re-ranks under two in a hundred
    rng = np.random.default_rng(6)
    assert recalled(spark, list(enumerate(rng.standard_normal((20_000, 64))))) >= 0.95


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64)
    near = [(i, (centre + 0.02 * rng.standard_normal(64)) * rng.uniform(0.1, 5)) for i in range(6000)]
    assert recalled(spark, near + [(i, rng.standard_normal(64)) for i in range(6000, 9000)]) >= 0.95


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive.train(x)

    def error(beam):
        codes, lengths, gaps = additive.encode(x, books, beam)
        near = books[np.arange(len(books)), codes].sum(1)
        assert np.allclose(np.linalg.norm(near, axis=1), lengths, atol=1e-3)
        assert np.allclose(np.linalg.norm(x - near / lengths[:, None], axis=1), gaps, atol=1e-3)
        return ((x - near) ** 2).sum()

    assert error(4) < error(1) < 0.5 * (x**2).sum()


def test_large_groups_of_unlike_rows_are_cut_deep(spark, monkeypatch):
    """4 million unlike rows of a label at the production cell, as the ratio of rows to CELL, and a group that is half alike."""
    from math import erf, sqrt

    apart = 0.32
    for ratio in (100, 500, 1562, 6250):
        rows = ratio * collisions.CELL
        depth = collisions.best_depth({d: (rows, rows * max(rows * apart**d, 1.0), min(rows, round(apart**-d))) for d in range(collisions.DEPTH + 1)})
        assert depth >= 5 and rows * apart**depth < 0.01 * rows
    alike = collisions.best_depth({d: (100_000, 100_000.0**2 * 0.87**d, 2**d) for d in range(collisions.DEPTH + 1)})
    assert alike == 0
    monkeypatch.setattr(collisions, "CELL", 32)
    rng = np.random.default_rng(3)
    data = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rng.standard_normal((20_000, 64)).tolist())], "vec_id long, embedding array<float>, label int")
    dealt = collisions.cells(collisions.classes_of(data)).groupBy("table", "cell").count()
    assert dealt.agg(F.max("count")).first()[0] <= 200 and dealt.select("table").distinct().count() > 10


def test_several_tables_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collisions, "best_depth", lambda met: 2)
    rows = clustered(300) + ODD + [(i, clustered(3)[1][1], 0) for i in range(700, 730)]
    got = sorted((tuple(r) for r in collisions.near_duplicates(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)
