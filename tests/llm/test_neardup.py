import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from meshquery.llm import neardup
from meshquery.llm.components import components
from meshquery.llm.words import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, "x") for i, t in rows], DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * len(a | sets[j]):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), low[root(k)], i == low[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def variants(n, words=150, edits=(0, 12), seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def result(spark, rows):
    return sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, "One two three four five six"), (2, "one  two\tthree FOUR five six"), (3, None), (4, ""), (5, " \n "), (6, "short text"), (7, "SHORT text"), (8, "short"), (None, "short"), (None, "alone of ids"), (9, "a b c d e"), (9, "a b c d e"), (3, "short text"), (10, "É é"), (11, "é é"), (12, "x\u00a0y z"), (13, "long " * 30_000), (14, "LONG " * 30_000)]
    assert result(spark, rows) == brute(rows)


def test_variants_of_one_text_and_shared_passages(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = variants(160, seed=2) + variants(60, words=400, edits=(0, 40), seed=3) + variants(40, words=30, edits=(0, 2), seed=5)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [texts[3]] * 40 + [texts[100].upper()] * 5
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_chains_of_links(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each close to the next only
        own = base[:]
        for k in range(i):
            own[(k * 5) % 200] = f"v{k}"
        rows.append((40 - i, " ".join(own)))
    assert result(spark, rows) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    got = sorted((tuple(r) for r in neardup.op3(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.deduplicated(frame(spark, [])).count() == 0


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand here now"), (3, "other words stand here now"), (4, None), (4, None), (5, ""), (None, "a b c d e f g"), (None, "no id but words"), (6, "no id but WORDS"), (7, "x y z"), (7, "X y z")]
    out = neardup.deduplicated(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "3", "4", "4", "5", "6", "7"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAB \n\té")), max_size=60), max_size=8))
def test_shingle_counts(texts):
    sets = Words(pa.array(texts, pa.string())).shingle_sets()
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(a) & shingles(b))


def test_bounds_follow_the_threshold():
    from math import comb

    for percent in (70, 75, 80, 85, 90, 95):
        p, n = percent / 100, neardup.least(percent)
        assert sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(n)) < 1e-5
        assert neardup.margin(percent) >= 400 * (p * (1 - p) / 64) ** 0.5
    assert (neardup.least(85), neardup.margin(85)) == (41, 20) and neardup.least(80) <= 38


def test_lower_threshold_against_brute_force(spark):
    texts = variants(120, edits=(0, 8), seed=7) + variants(60, words=400, edits=(0, 24), seed=8) + variants(40, words=30, edits=(0, 2), seed=9)
    rows = list(enumerate(texts, 1))
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in range(1, i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), 80).collect()}
    assert got == label != {i: c for i, _, c, _ in brute(rows)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70), (200, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (50, 70, 100, 200)} == {50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_texts_of_one_id_or_none(spark):
    rows = [(None, t) for t in variants(50, seed=11)] + [(7, t) for t in variants(50, seed=12)] + list(enumerate(variants(20, seed=13)))
    rows += rows[:10] + [(7, "one text of many"), (None, "one text of many")] * 20
    assert result(spark, rows) == brute(rows)


def test_long_lists_are_led_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_LEADS", 16)
    rng = random.Random(14)
    # Halves in common: many members of one list in many components, no two of them linked but for the planted ones.
    shared = [f"s{i}" for i in range(100)]
    texts = [" ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(12)]) for _ in range(90)]
    texts += variants(30, words=112, edits=(0, 3), seed=15)
    rows = list(enumerate(texts))
    assert result(spark, rows) == brute(rows)


def test_pairs_just_above_the_threshold_are_found(spark):
    rng, rows = random.Random(16), []
    while len(rows) < 300:
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        other, near = own[:], 1.0
        while near >= 0.87:
            other[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            a, b = shingles(" ".join(own)), shingles(" ".join(other))
            near = len(a & b) / len(a | b)
        if near >= 0.85:
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    found = {i: c for i, _, c, _ in result(spark, rows)}
    assert all(found[i] == i - i % 2 for i in found)


def test_components_are_made_of_new_links_only(spark, monkeypatch):
    made, own = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: made.append(links.count()) or own(links))
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, *[f"x{i}"] * (i > 1)])) for i in (1, 2, 3)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {1}
    assert made == [2]
