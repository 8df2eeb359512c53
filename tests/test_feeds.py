import json
import os

from meshquery.streaming import feeds

EVENTS = "user string, ts timestamp, n long"


def files(folder, batches):
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes files by their time


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))


def rows(k, n=4):
    return [{"user": f"u{i % 2}", "ts": f"2024-01-{k + 1:02d}T00:00:{i:02d}Z", "n": 10 * k + i} for i in range(n)]


def test_rotation_starts_new_folders(spark, tmp_path):
    files(tmp_path / "in", [rows(k) for k in range(5)])
    feeds.append_rotating(stream(spark, tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "at"), 2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("part")) == ["part=0", "part=1", "part=2"]
    got = spark.read.json(str(tmp_path / "log"))
    assert sorted(r.n for r in got.collect()) == sorted(r["n"] for k in range(5) for r in rows(k))
    feeds.append_rotating(stream(spark, tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "at"), 2).awaitTermination()
    assert got.count() == 20


def test_collection_keeps_the_newest_of_each_key(spark, tmp_path):
    files(tmp_path / "in", [rows(k) for k in range(4)])
    feeds.collected_every(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), ["user"], 3, ticks=3).awaitTermination()
    last = spark.read.schema(EVENTS).parquet(str(tmp_path / "out" / "version=1" / "batch=*"))
    # batches 0 to 2 leave the newest three of each user; batch 3 follows whole
    assert sorted(r.n for r in last.collect()) == [12, 13, 20, 21, 22, 23, 30, 31, 32, 33]
    assert spark.read.schema(EVENTS).parquet(str(tmp_path / "out" / "version=0" / "batch=*")).count() == 12


def test_progress_becomes_events(spark, tmp_path):
    import time

    files(tmp_path / "in", [rows(0)])
    seen = []
    listener = feeds.ProgressEvents(seen.append)
    spark.streams.addListener(listener)
    try:
        query = stream(spark, tmp_path / "in").writeStream.queryName("told").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(50):
            if any(e["type"] == "runtime_stopped" for e in seen):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [e["type"] for e in seen if e["name"] in ("told", None)][0] == "runtime_started" and seen[-1]["type"] == "runtime_stopped"
    assert sum(e["rows"] or 0 for e in seen) == 4


POINTS = "domain string, url string, field string, ts timestamp, value double"


def test_late_points_give_the_alerts_of_the_batch_query(spark, tmp_path):
    import random

    from meshquery.operators import timeseries

    rng = random.Random(6)
    points = [{"domain": "d", "url": f"u{i % 3}", "field": "f", "ts": f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z", "value": float(rng.randrange(100))} for i in range(240)]
    points += [dict(points[7], value=3.0)]  # two points of one time
    rules = spark.createDataFrame([("r1", "d", "f", "value_above", 50.0, True), ("r2", "d", "f", "value_below", 20.0, True), ("r3", "d", "f", "change_by_percent", 0.5, True)], "id string, domain string, field string, condition string, threshold double, active boolean")
    ended = {"domain": "end", "url": "u", "field": "f", "ts": "2024-01-03T00:00:00Z", "value": 0.0}
    frame = spark.read.schema(POINTS).json(spark.sparkContext.parallelize([json.dumps(p) for p in points]))
    want = sorted(map(str, timeseries.alerts(frame, rules).select("id", "url", "ts", "before", "value").collect()))
    for split, size in (("a", 300), ("b", 60)):
        mixed = sorted(points, key=lambda p: (int(p["ts"][11:13]) * 60 + int(p["ts"][14:16])) + rng.uniform(0, 55))  # late by less than an hour
        files(tmp_path / split, [mixed[i : i + size] for i in range(0, len(mixed), size)] + [[ended], [dict(ended, url="v")]])
        source = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / split))
        out = str(tmp_path / f"out-{split}")
        feeds.alert_stream(source, rules, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"at-{split}")).trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(str, spark.read.parquet(out).where("domain = 'd'").select("id", "url", "ts", "before", "value").collect()))
        assert got == want and len(want) > 50


def test_readers_see_one_version(spark, tmp_path):
    files(tmp_path / "in", [rows(k) for k in range(8)])
    out = str(tmp_path / "out")
    feeds.collected_every(stream(spark, tmp_path / "in"), out, str(tmp_path / "at"), ["user"], 3, ticks=3).awaitTermination()
    # batches 0 to 5 leave the newest three of each user; batches 6 and 7 follow whole
    assert sorted(r.n for r in feeds.collected(spark, out, EVENTS).collect()) == [42, 43, 50, 51, 52, 53, 60, 61, 62, 63, 70, 71, 72, 73]
    assert not (tmp_path / "out" / "version=0").exists()
    files(tmp_path / "in2", [rows(0)])
    feeds.collected_every(stream(spark, tmp_path / "in2"), out + "2", str(tmp_path / "at2"), ["user"], 3, ticks=3).awaitTermination()
    assert feeds.collected(spark, out + "2", EVENTS).count() == 4


def test_state_calls_are_per_bucket_and_rules_are_broadcast(spark, tmp_path, monkeypatch):
    # 600 series in 4 buckets: each series has its own steps, and no call or shuffle is per series or per kind of rule
    monkeypatch.setattr(feeds, "BUCKETS", 4)
    points = [{"domain": "d", "url": f"u{i}" if i else None, "field": "f", "ts": f"2024-01-01T0{t}:00:00Z", "value": float(i + 1000 * t)} for t in range(3) for i in range(600)]
    files(tmp_path / "in", [points[:900], points[900:]])
    rules = spark.createDataFrame([("up", "d", "f", "value_above", 1599.5, True)], "id string, domain string, field string, condition string, threshold double, active boolean")
    for lateness in (None, "1 hour"):
        source = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out, at = str(tmp_path / f"out-{lateness}"), str(tmp_path / f"at-{lateness}")
        query = feeds.alert_stream(source, rules, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        state = query.recentProgress[0]["stateOperators"][0]
        assert state["numRowsTotal"] <= 4 * 4  # a few rows a bucket, not one or more a series
        if lateness is None:
            got = sorted((r.url or "", r.before, r.value) for r in spark.read.parquet(out).collect())
            assert got == sorted((f"u{i}" if i else "", 1000.0 + i, 2000.0 + i) for i in range(600))


def test_held_points_are_never_broadcast(spark, tmp_path, monkeypatch):
    # a batch of one small row gives all points that waited: its input is smaller than the rules, what it gives is not
    points = [{"domain": "d", "url": f"u{i}", "field": "f", "ts": f"2024-01-01T0{t}:00:00Z", "value": float(i + 1000 * t)} for t in range(3) for i in range(200)]
    ended = [{"domain": "end", "url": f"{k}", "field": "f", "ts": "2024-01-09T00:00:00Z", "value": 0.0} for k in range(2)]
    files(tmp_path / "in", [points, *[[e] for e in ended]])
    rules = spark.range(300).selectExpr("'rule-' || id || '-' || sha2(string(id), 256) AS id", "'d' AS domain", "'f' AS field", "'value_above' AS condition", "1000.0D + id AS threshold", "true AS active")
    got = []
    for most in (feeds.RULES, 100):  # the second time the rules count as many, and are joined by sort
        monkeypatch.setattr(feeds, "RULES", most)
        out, at = str(tmp_path / f"out-{most}"), str(tmp_path / f"at-{most}")
        source = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = feeds.alert_stream(source, rules, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 300)
        got.append(sorted((r.id.split("-")[1], r.url, r.before, r.value) for r in spark.read.parquet(out).collect()))
    want = sorted((str(r), f"u{i}", float(i + 1000 * t - 1000), float(i + 1000 * t)) for r in range(300) for t in (1, 2) for i in range(200) if i + 1000 * t > 1000 + r >= i + 1000 * t - 1000)
    assert got[0] == got[1] == want and want
