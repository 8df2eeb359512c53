from collections import Counter

import corpus_pipeline
from meshquery.llm import mixing, neardup, quality
from meshquery.llm.common import saved

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and corpus_pipeline.ORACLE_SQL is None
    quality_stage, dedup, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    one = saved(quality_stage(spark, docs, SF), "one")
    scores = quality.op2(spark, SF).toPandas()
    assert sorted(r.doc_id for r in one.collect()) == sorted(scores[scores.predicted == 1].doc_id)
    two = saved(dedup(spark, one, SF), "two")
    parts = neardup.near_duplicates(one, 80).toPandas()
    assert sorted(r.doc_id for r in two.collect()) == sorted(parts[parts.kept].doc_id)
    three = saved(mix(spark, two, SF), "three")
    takes = {r.doc_id: r for r in mixing.mix(two).collect() if r.taken}
    times = Counter(r.doc_id for r in three.collect())
    assert set(times) == set(takes) and all(times[i] == -(-takes[i].taken // takes[i].size) for i in times)
    for df in (one, two, three):
        assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
    four = pack(spark, three, SF).toPandas()
    assert (four[four.start == 0].groupby("doc_id").size().sort_index() == [times[i] for i in sorted(times)]).all()
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, run[["doc_id", "start", "length", "ids_crc32"]].values)) != [] and len(run) > 0


def test_odd_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (None, "words without an id", "en", "t", 1), (3, "", "en", "s", 0)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SF), "stage")
        assert docs.count() >= bool(table)


def test_dedup_stage_links_from_four_fifths(spark):
    base = [f"w{i}" for i in range(500)]
    other = [f"v{i}" for i in range(500)]
    changed = lambda words, n: " ".join("e%d" % i if i < n * 5 and i % 5 == 0 else w for i, w in enumerate(words))
    cut = lambda words, n: " ".join(words[: len(words) - n])
    texts = {1: " ".join(base), 2: cut(base, 89), 3: " ".join(other), 4: changed(other, 30)}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.815 < near(1, 2) < 0.825 and near(3, 4) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect()) == [1, 3, 4]
    assert {r.doc_id for r in neardup.near_duplicates(docs).collect() if r.kept} == {1, 2, 3, 4}
    given = spark.read.parquet(f"{SF}/documents.parquet")
    parts = neardup.near_duplicates(given, 80).where("kept")
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, given, SF).collect()) == sorted(r.doc_id for r in parts.collect())


def test_pipeline_against_brute_force(spark):
    """What each stage keeps, from its own input, by plain Python; the classifier by its held-out accuracy and its scores."""
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality_stage, dedup, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    one = saved(quality_stage(spark, docs, SF), "one")
    score = {r.doc_id: r.score for r in quality.op2(spark, SF).collect()}
    rows = one.collect()
    assert {r.doc_id for r in rows} == {i for i, s in score.items() if s >= 0.5}

    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    two = saved(dedup(spark, one, SF), "two")
    assert sorted(r.doc_id for r in two.collect()) == [i for i in ids if root(i) == i]

    three = saved(mix(spark, two, SF), "three")
    kept = two.collect()
    size = {s: sum(len(words(r.text)) for r in kept if r.source == s) for s in {r.source for r in kept}}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, left, total = {}, set(size), float(sum(size.values()))
    while True:  # water filling, step by step
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] >= 3 * size[s]}
        if not full or full == left:
            target |= {s: min(share[s], 3 * size[s]) for s in left}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= full
    mixed = three.collect()
    for s in size:
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - target[s]) <= 1

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed)
    pieces = pack(spark, three, SF).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by) == list(range(len(by)))
    for at in by.values():
        at.sort()
        assert at[0][0] == 0 and all(o + n == m for (o, n), (m, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= 2048
    assert sum(n for at in by.values() for _, n in at) == sum(n * k for (_, n), k in want.items())


def test_columns_that_clash_with_the_stages_own(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    from pyspark.sql import functions as F

    clash = {n: F.lit("clash") for n in ("__id", "__tag", "tag", "label", "n", "row", "cls", "key", "x", "kept", "score")}
    docs = saved(plain.withColumns(clash), "clash")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    for stage in stages[:-1]:
        out = saved(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in stage(spark, docs.select(plain.columns), SF).collect())
    assert stages[-1](spark, docs, SF).count() > 0
