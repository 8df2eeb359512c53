import glob
import os

import pytest
from pyspark.sql import functions as F

from meshquery import scale_queries
from meshquery.sources import site_source


def made(spark, n=3, pages=5):
    site_source.register(spark)
    nodes = spark.range(n * pages).select(F.concat(F.lit("s"), (F.col("id") % n).cast("string"), F.lit(".test")).alias("domain"), (F.col("id") * 2).cast("int").alias("node_id"), F.concat(F.lit("/é/"), "id").alias("url"), F.lit(4).alias("page_type"), F.lit(9).alias("confidence"), F.lit(1).alias("flags"), F.array_repeat(F.lit(0.5).cast("float"), 128).alias("features"))
    edges = nodes.select("domain", F.col("node_id").alias("src"), (F.col("node_id") + 2 * n).alias("dst"), F.lit(1).alias("edge_type"), F.lit(3).alias("weight"), F.lit(4).alias("flags"))
    actions = nodes.select("domain", "node_id", F.lit(2).alias("category"), F.lit(1).alias("action"), F.col("node_id").alias("target_node"), F.lit(5).alias("cost_hint"), F.lit(1).alias("risk"))
    return nodes, edges, actions


def test_round_trip_pushdown_and_commit(spark, tmp_path):
    at = str(tmp_path)
    nodes, edges, actions = made(spark)
    site_source.sites(nodes, edges, actions).write.format("sitefile").mode("append").save(at)
    read = lambda part: spark.read.format("sitefile").option("part", part).load(at)
    assert sorted((r.domain, r.node_id, r.url) for r in read("nodes").collect()) == sorted((f"s{i % 3}.test", i // 3, f"/é/{i}") for i in range(15))
    assert sorted(tuple(r) for r in read("edges").collect()) == sorted((f"s{k}.test", i, i + 1, 1, 3, 4) for k in range(3) for i in range(4))
    assert sorted(tuple(r) for r in read("actions").collect()) == sorted((f"s{k}.test", i, 2, 1, i, 5, 1) for k in range(3) for i in range(5))
    one = read("nodes").where("domain = 's1.test'")
    assert one.count() == 5 and "Filter (domain" not in one._jdf.queryExecution().optimizedPlan().toString()
    with open(glob.glob(f"{at}/write-*/s1.test-*.ctx")[0].replace("s1.test", "s9.test"), "wb") as f:  # of an attempt that didn't count
        f.write(b"half")
    os.makedirs(f"{at}/write-lost")
    with open(f"{at}/write-lost/s9.ctx", "wb") as f:
        f.write(b"half")
    assert read("nodes").count() == 15
    site_source.sites(nodes.where("domain = 's0.test'")).write.format("sitefile").mode("overwrite").save(at)
    assert read("nodes").count() == 5 and read("edges").count() == 0
    broken = glob.glob(f"{at}/write-*/s0.test-*.ctx")[0]
    with open(broken, "r+b") as f:
        f.seek(40)
        f.write(b"\xff")
    with pytest.raises(Exception, match="checksum mismatch"):
        read("nodes").collect()


def test_no_sites(spark, tmp_path):
    nodes, edges, actions = made(spark)
    site_source.sites(nodes.limit(0), edges, actions).write.format("sitefile").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("sitefile").load(str(tmp_path / "none")).count() == 0


def test_links_to_the_next_pages_meet_by_blocks(spark):
    pages = spark.range(400).select(F.lit("one").alias("domain"), F.col("id").cast("int").alias("node_id"))
    links = scale_queries._next_links(pages, 60)
    assert sorted((r.src, r.dst) for r in links.collect()) == [(i, j) for i in range(400) for j in range(i + 1, min(400, i + 61))]
    joined = [line for line in links._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joined and all("block#" in line for line in joined)


def test_a_site_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    import io
    import random

    import numpy as np
    import pandas as pd

    from meshquery.sources import site_files

    nodes, edges, actions = made(spark)
    assert "CoGroup" not in site_source.sites(nodes, edges, actions)._jdf.queryExecution().toString()  # no task gets a whole site
    rng, spare = random.Random(4), np.random.default_rng(4)
    ids = sorted(rng.sample(range(10_000), 700))
    links = sorted((rng.choice(ids + [10_001]), rng.choice(ids + [10_002]), rng.randrange(9), rng.randrange(256), rng.randrange(256)) for _ in range(3000))
    acts = [(rng.choice(ids + [10_001]), 2, rng.randrange(3), rng.choice(ids + [-1, 10_003]), rng.randrange(9), rng.randrange(9)) for _ in range(3000)]
    pages = pd.DataFrame({"domain": "a.test", "node_id": ids, "url": ["/é" * (i % 40) + str(i) for i in ids], "page_type": 4, "confidence": 200, "flags": 1, "features": spare.random((700, 128), "f4").tolist(), "http_status": 404, "cluster": [i % 999 for i in ids]})
    frame = spark.createDataFrame(pages, "domain string, node_id int, url string, page_type int, confidence int, flags int, features array<float>, http_status int, cluster int").repartition(5)
    linked = spark.createDataFrame([("a.test", *x) for x in links] + [("none.test", 1, 2, 3, 4, 5)], "domain string, src int, dst int, edge_type int, weight int, flags int").repartition(3)
    acted = spark.createDataFrame([("a.test", *x) for x in acts], "domain string, node_id int, category int, action int, target_node int, cost_hint int, risk int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    monkeypatch.setattr(site_source, "PIECE", 5000)
    try:
        site_source.sites(frame, linked, acted).write.format("sitefile").mode("append").save(str(tmp_path))
        rows = site_source.sites(frame, linked, acted).coalesce(1).toArrow().to_batches(max_chunksize=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    place = {n: i for i, n in enumerate(ids)}
    table = np.zeros(700, site_files.NODE)
    for name, value in (("page_type", 4), ("confidence", 200), ("flags", 1), ("http_status", 404)):
        table[name] = value
    features = np.array(pages.features.tolist(), "f4")
    table["norm"] = np.linalg.norm(features, axis=1)
    want = site_files.ctx_bytes({"domain": "a.test", "nodes": table, "features": features, "urls": pages.url.tolist(), "clusters": pages.cluster.tolist(), "edges": [(place[a], place[b], *x) for a, b, *x in links if a in place and b in place], "actions": [(place[n], c * 256 + a, place.get(t, -1), *x) for n, c, a, t, *x in acts if n in place]})
    (file,) = glob.glob(f"{tmp_path}/write-*/*.ctx")
    with open(file, "rb") as f:
        assert f.read() == want
    made_ = list(site_source.pieces(iter(rows)))
    assert b"".join(x[2] for x in made_) == want and len(made_) > 40 and [x[1] for x in made_] == [True] + [False] * (len(made_) - 1)
    whole = site_files.ctx_site(want)
    monkeypatch.setattr(site_files, "SLICE", 10)
    for part in site_files.PARTS:
        slices = list(site_files.site_slices(io.BytesIO(want), part, len(want)))
        assert len(slices) > 20 and max(map(len, slices)) <= 100
        got, all_ = pd.concat(slices, ignore_index=True), site_files.site_rows(whole, part)
        assert got.drop(columns="features", errors="ignore").astype(str).equals(all_.drop(columns="features", errors="ignore").astype(str))
    assert (np.stack(pd.concat(site_files.site_slices(io.BytesIO(want), "nodes", len(want))).features) == features).all()
    for bad in (want[:-20], want[:100], want[:3], b"x" + want[1:]):
        with pytest.raises(site_files.BadFile):
            list(site_files.site_slices(io.BytesIO(bad), "nodes", len(bad)))
