import zlib

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshquery.llm import packing, wavelet
from meshquery.llm.tokens import encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, n long"
ODD = [
    "", " ", "a  b", " a", "x\n\ny", "tab\there", "a, b.c ,d... e!!, f", "it's A'S b'll.", "é, È. ñ x", "ΑΣ Σ", "a\x00b",
    "x<|endoftext|>y, z", "<|ENDOFTEXT|> q", "é, Å. K", "日本, 語。x 1,2 3.", "ab.\ncd, ef.", "x y", "a\u0085b", "a.\n", "word " * 3000,
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 8) for i, t in rows], DOCS)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library_on_odd_texts(path):
    import pyarrow as pa

    flat, lengths = encoder(path).encode(pa.array(ODD))
    ends = np.cumsum(lengths)
    plain = Tokenizer.from_file(path)
    for text, e, n in zip(ODD, ends, lengths, strict=True):
        assert flat[e - n : e].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_slices_of_a_column(path):
    import pyarrow as pa

    column = pa.array(ODD * 20, pa.string())
    column = pa.concat_arrays([column, column.slice(3)])
    coder = encoder(path)
    for at in (0, 7, 111):
        assert coder.encode(column.slice(at, 60))[0].tolist() == coder.encode(pa.array(column.to_pylist()[at : at + 60]))[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB ,.\n'!é1\t ́sS")), max_size=25), max_size=6))
def test_ids_equal_the_library_on_random_texts(texts):
    import pyarrow as pa

    for path in (WORD, BYTE):
        coder = encoder(path)
        flat, lengths = coder.encode(pa.array(texts, pa.string()))
        assert flat.tolist() == [i for t in texts for i in coder.tokenizer.encode(t, add_special_tokens=False).ids]
        assert len(lengths) == len(texts)


def check_pieces(rows, texts, length=2048):
    plain = Tokenizer.from_file(WORD)
    whole = {}
    for i, t in texts:
        whole.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    used = {}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = next(x for x in whole[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32)
        assert len(ids) >= r.start + r.length and r.length > 0
    for i, all_ids in whole.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, all_ids))
    sums = []
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        sums.append(at)
    assert sorted(sums)[1:] == [length] * (len(sums) - 1)


def test_packing_on_odd_repeated_and_null_rows(spark):
    texts = [*enumerate(ODD), (50, None), (50, None), (None, "no id"), (60, "same text"), (61, "same text"), (60, "same text")]
    check_pieces(packing.pack(frame(spark, texts), WORD, ids=False).collect(), texts)


def test_packing_of_an_empty_table(spark):
    out = packing.pack(frame(spark, []), WORD)
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "start"]
    assert packing.padding(out).first().padding == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_index(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_puts_similar_documents_together(spark):
    rng = np.random.default_rng(5)
    words = [[f"{c}{i}" for i in range(30)] for c in ("alpha", "beta", "gamma", "delta")]
    texts = [(i, " ".join(rng.choice(words[i % 4], 60))) for i in range(200)]
    out = packing.pack(frame(spark, texts), WORD, ids=False).toPandas().sort_values(["sequence_id", "offset"])
    kinds = (out.drop_duplicates("doc_id").doc_id % 4).to_numpy()
    assert (kinds[1:] == kinds[:-1]).mean() > 0.6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=300), st.integers(0, 60))
def test_shard_access_count_select(ids, value):
    data = np.array(ids, dtype=np.uint32)
    shard = wavelet.Shard(wavelet.build(data, [1, None], np.array([len(ids), 0])))
    assert shard.decode().tolist() == ids
    assert [shard.access(i) for i in range(0, len(ids), 7)] == ids[::7]
    half = len(ids) // 2
    assert shard.count(value) == ids.count(value) and shard.count(value, half) == ids[half:].count(value)
    assert shard.positions(value) == [i for i, x in enumerate(ids) if x == value]
    assert shard.select(value, ids.count(value)) == -1
    assert shard.documents()[0] == [1, None]


def test_shard_with_many_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 13)
    ids = np.random.default_rng(1).zipf(1.3, 50_000).astype(np.uint32) % 50_257
    shard = wavelet.Shard(wavelet.build(ids, [0], np.array([len(ids)])))
    assert (shard.decode() == ids).all()
    for value in (1, 2, 17, 50_000):
        assert shard.positions(value)[:50] == np.flatnonzero(ids == value)[:50].tolist()
    assert [shard.access(i) for i in (0, 8191, 8192, 49_999)] == ids[[0, 8191, 8192, 49_999]].tolist()


def test_shards_round_trip(spark):
    texts = [*enumerate(ODD), (50, None), (3, "again"), (3, "again"), (None, "no id")]
    got = wavelet.read_back(wavelet.write_shards(frame(spark, texts[::-1]), BYTE), ids=True).toPandas().sort_values("start")
    plain = Tokenizer.from_file(BYTE)
    at = 0
    for (i, t), r in zip(sorted(texts, key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")), got.itertuples(), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (pd.isna(r.doc_id) and i is None) or r.doc_id == i
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_no_shards_of_an_empty_table(spark):
    assert wavelet.read_back(wavelet.write_shards(frame(spark, []), BYTE)).count() == 0


def test_whole_tables(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    check_pieces(packing.op1(spark, "/root/testdata/sf0.001").collect(), list(zip(docs.doc_id, docs.text, strict=True)))
    got = wavelet.op4(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    plain = Tokenizer.from_file(BYTE)
    ids = [plain.encode(t, add_special_tokens=False).ids + [2] for t in docs.sort_values("doc_id").text]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()


def test_many_rows_of_one_id_spread_over_parts(spark):
    rows = [(5, f"text {i:04d}") for i in range(400)] + [(None, "no id")] * 300 + [(6, "copy")] * 300 + [(i, "x") for i in range(10, 20)]
    shards = wavelet.write_shards(frame(spark, rows), BYTE, parts=8)
    assert shards.select("part").distinct().count() >= 6 and max(r.docs for r in shards.collect()) < 400
    got = wavelet.read_back(shards, ids=True).toPandas().sort_values("start")
    plain, at = Tokenizer.from_file(BYTE), 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1])), got.itertuples(), strict=True):
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        assert (pd.isna(r.doc_id) and i is None) or r.doc_id == i
        assert (r.start, list(r.ids)) == (at, ids)
        at += len(ids)
