"""Operator 13: round trips, SQL, other archives, damage."""

import base64
import glob
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from meshquery.llm import warc

PAGES = "page_id long, url string, html string, payload string, row long, key string, salt int, first string"


@pytest.fixture(autouse=True)
def known(spark):
    warc.register(spark)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2, "clash") for r in rows], PAGES)


def many():
    rows = [(i, f"http://h{i}.test/", "é<p>" * (i * 7 % 400)) for i in range(300)]
    rows += [(1000 + i, None, "long copy " * 200) for i in range(200)] + [(2000 + i, "http://s/", "short") for i in range(20)]
    return rows + [(None, "http://n/", "long copy " * 200), (1199, "http://again/", "long copy " * 200), (1199, "http://again/", "long copy " * 200), (3000, "http://odd/\r\nX: y z", None), (3001, "", ""), (None, None, None), (-5, "u", "neg " * 400), (None, "u", "neg " * 400), (4000, "u", "x" * 2_500_000), (4001, "u", "x" * 2_500_000)]


def by_sql(rows):
    import pandas as pd

    db = duckdb.connect()
    db.register("pages", pd.DataFrame({"page_id": pd.array([r[0] for r in rows], dtype="Int64"), "url": [r[1] for r in rows], "html": pd.array([r[2] for r in rows], dtype="string")}))
    return sorted(db.sql(warc.SQL).fetchall(), key=str)


def test_round_trip_and_sql(spark, tmp_path):
    rows = many()
    warc.archive(pages(spark, rows), str(tmp_path))
    out = warc.archived(spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.collect()), key=str) == by_sql(rows)
    full = spark.read.format("warc").load(str(tmp_path)).toPandas()
    assert len(full) == len(rows) and full.record_id.is_unique and not full.problem.notna().any()
    kept = full[full.record_type == "response"].set_index("record_id")
    again = full[full.record_type == "revisit"]
    assert set(again.refers_to) <= set(kept.index) and again.payload.isna().all() and all(kept.loc[r].payload_digest == d for r, d in zip(again.refers_to, again.payload_digest, strict=True))
    have = sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows)
    assert sorted(full.payload_digest) == have and all(hashlib.sha1(p).hexdigest() == d for p, d in zip(kept.payload, kept.payload_digest, strict=True))
    assert "http://odd/%0D%0AX:%20y%20z" in set(full.target_uri)


def test_one_member_a_record(spark, tmp_path):
    warc.archive(pages(spark, many()[:40]), f"file://{tmp_path}")
    offsets = spark.read.format("warc").load(str(tmp_path)).select("file", "offset", "record_id").collect()
    for file, offset, record_id in offsets:
        data = zlib.decompressobj(31).decompress(open(file, "rb").read()[offset:])
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID") == 1 and record_id.encode() in data and data.endswith(b"\r\n\r\n")


def test_rotation_manifest_and_overwrite(spark, tmp_path):
    at = str(tmp_path)
    warc.archive(pages(spark, many()), at)
    frame = warc.page_records(pages(spark, many()[:100]))
    frame.write.format("warc").mode("append").option("file_bytes", "200").save(at)
    assert warc.archived(spark, at).count() == len(many()) + 100 and len(glob.glob(f"{at}/write-*/*.warc.gz")) > 100
    stray = f"{at}/write-lost"
    import os

    os.mkdir(stray)
    with open(f"{stray}/part.warc.gz", "wb") as f:  # an attempt that didn't count
        f.write(b"half a file")
    assert warc.archived(spark, at).count() == len(many()) + 100
    frame.write.format("warc").mode("overwrite").save(at)
    assert warc.archived(spark, at).count() == 100
    os.remove(warc.archive_files(at)[0][0])
    with pytest.raises(FileNotFoundError):
        warc.archive_files(at)


def test_nothing(spark, tmp_path):
    warc.archive(pages(spark, []), str(tmp_path))
    assert warc.archived(spark, str(tmp_path)).count() == 0


OTHER = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nX-Long: a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 92\r\n\r\n"
    b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\nX-A: b\r\n\r\n5;n=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
)


@pytest.mark.parametrize("pack", ["plain", "one member", "members"])
def test_archives_of_others(spark, tmp_path, pack):
    data = OTHER if pack == "plain" else gzip.compress(OTHER) if pack == "one member" else b"".join(gzip.compress(b"WARC/1.0" + r) for r in OTHER.split(b"WARC/1.0")[1:])
    file = tmp_path / ("a.warc" if pack == "plain" else "a.warc.gz")
    file.write_bytes(data)
    got = spark.read.format("warc").load(str(file)).orderBy("record_id").collect()
    assert [(r.record_type, r.http_status, r.payload_bytes, bytes(r.payload)) for r in got] == [("warcinfo", None, 12, b"software: x\n"), ("response", 404, 11, b"hello world"), ("resource", None, 5, b"hello")]
    assert got[1].fields["x-long"] == "a b"


def read(data, packed=True):
    return list(warc.records(io.BytesIO(data), packed))


def test_damage(spark, tmp_path):
    row = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "payload": b"body " * 1000, "payload_bytes": 5000, "payload_digest": None, "refers_to": None, "refers_to_uri": None}
    one = warc.record(row, "2024-01-01T00:00:00Z")
    good = warc.member(one, 6)
    assert [r["problem"] for r in read(good * 3)] == [None] * 3
    assert "block digest" in read(warc.member(one.replace(b"body body", b"bodY body"), 6))[0]["problem"]
    digest = base64.b32encode(hashlib.sha1(row["payload"]).digest())
    assert "payload digest" in read(warc.member(one.replace(digest, base64.b32encode(b"0" * 20)), 6))[0]["problem"]
    assert [bool(r["problem"]) for r in read(good + good[:-20])] == [False, True]
    assert "length" in read(warc.member(one.replace(b"\r\nContent-Length: 50", b"\r\nContent-Length: 40", 1), 6))[0]["problem"]
    assert "gzip" in read(good[:200] + b"\x00\x01" + good[202:])[0]["problem"]
    assert "version" in read(b"hello\n", packed=False)[0]["problem"] and read(b"", packed=False) == []
    (tmp_path / "b.warc.gz").write_bytes(good + warc.member(one.replace(b"body body", b"bodY body"), 6) + good)
    loose = spark.read.format("warc").option("strict", "false").load(str(tmp_path)).collect()
    assert [bool(r.problem) for r in loose] == [False, True, False]
    with pytest.raises(Exception, match="block digest differs"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_a_large_record_is_read_in_chunks():
    row = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "payload": bytes(80_000_000), "payload_bytes": 0, "payload_digest": None, "refers_to": None, "refers_to_uri": None}
    data = warc.member(warc.record(row, "d"), 1)
    import tracemalloc

    tracemalloc.start()
    got = list(warc.records(io.BytesIO(data), True, keep=False))
    assert got[0]["payload_bytes"] == 80_000_000 and got[0]["problem"] is None and tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()
