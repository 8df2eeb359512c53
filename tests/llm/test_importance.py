"""Operator 12 against a dictionary of every run of words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshquery.llm import importance

DOCS = "doc_id long, text string, row long, words long, score string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in rows], DOCS)


def target(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, features string")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, longest=2):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, aims):
    have = Counter(f % 10_000 for _, t in rows for f in features(t))
    want = Counter(f % 10_000 for _, t in aims for f in features(t))
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s_all + 10_000) / ((have[b] + 1) * (t_all + 10_000))))
    out = []
    for i, t in rows:
        f = [x % 10_000 for x in features(t)]
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(t))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = None
        r.append(rank)
    return sorted(((*r[:4], r[5] if len(r) > 5 else None) for r in out), key=str)


def corpus(n, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "the", "naïve", "Été", "x9", "a_b", "don't", "7", "ß", "日本", *(f"w{i}" for i in range(60))]
    return [(i, "".join(vocabulary[k] + [" ", ", ", "\n", "\x00", "--"][j] for k, j in zip(rng.integers(0, len(vocabulary), m), rng.integers(0, 5, m), strict=True))) for i, m in enumerate(rng.integers(0, 70, n))]


def test_whole_result_against_brute_force(spark):
    rows = corpus(300) + [(500, None), (501, ""), (502, "..."), (503, "One"), (504, "é" * 5), (None, "w1 " * 30), (None, "w1 " * 30), (None, "w2 " * 25), (7, "w1 " * 30)]
    rows += [(600, "w3 w4 " * 40)] * 150 + [(601 + i, "w3 w4 " * 40) for i in range(40)]
    aims = corpus(40, seed=6) + [(900, None), (901, "")]
    got = importance.resample(docs(spark, rows), target(spark, aims)).drop("row")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, aims)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_hashes_of_all_runs(longest):
    texts = [t for _, t in corpus(80)] + [None, "", "w1 w1 w1 w1 w1 w1 w1", "w1 w1", "w1", ".", "w1 w2 w1 w2 w1 w2"]
    hashes, per_text, counts = importance.gram_hashes(pa.array(texts), longest)
    at = 0
    for text, n, w in zip(texts, per_text.tolist(), counts.tolist(), strict=True):
        assert Counter(hashes[at : at + n].tolist()) == Counter(features(text, longest)) and w == len(words_of(text))
        at += n
    assert at == len(hashes)


def test_one_hash_per_distinct_run(monkeypatch):
    calls = []
    real = zlib.crc32
    monkeypatch.setattr(importance.zlib, "crc32", lambda *a: calls.append(a) or real(*a))
    importance.gram_hashes(pa.array(["a b c a b c a b"] * 50))
    assert len(calls) == 3 + 3  # a, b, c; a b, b c, c a


def test_suffix_order():
    ids = np.array([2, 1, 2, 1, 0, 1, 2, 1, 2, 2, 0])
    order = importance.suffix_array(ids, 4)
    key = lambda p: tuple(ids[p : p + 4].tolist())
    assert [key(p) for p in order] == sorted(key(p) for p in range(len(ids)) if ids[p]) and importance.common_prefixes(ids, order, 4)[0] == 0


def test_a_very_long_text(spark):
    rows = [(1, "alpha beta gamma " * 400_000), (2, "x" * 3_000_000), (3, "- " * 500_000)]
    got = {r.doc_id: r for r in importance.resample(docs(spark, rows), target(spark, [(1, "alpha")])).collect()}
    assert [got[i].n_features for i in (1, 2, 3)] == [2 * 1_200_000 - 1, 1, 0] and got[3].weight == 0


def test_drawn_documents_keep_their_columns(spark):
    rows = [(i, f"w{i} " * 5 + "common word " * (10 if i % 2 else 1)) for i in range(200)]
    out = importance.drawn(docs(spark, rows), target(spark, [(1, "common word " * 50)]), percent=50)
    ranked = {r.doc_id for r in importance.resample(docs(spark, rows), target(spark, [(1, "common word " * 50)]), percent=50).collect() if r.rank}
    assert out.columns == ["doc_id", "text", "row", "words", "score", "part"] and {r.doc_id for r in out.collect()} == ranked and len(ranked) == 50


def test_nothing(spark):
    assert importance.resample(docs(spark, []), target(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in importance.resample(docs(spark, [(1, None)]), target(spark, [])).collect()] == [(1, 0, 0, r[4], None) for r in importance.resample(docs(spark, [(1, None)]), target(spark, [])).collect()]
