import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquery.operators import timeseries as ts
from meshquery.streaming import feeds

START = dt.datetime(2024, 1, 1)


def series(spark, **named):
    rows = [("d", k, "f", START + dt.timedelta(days=i), float(v)) for k, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "domain string, url string, field string, ts timestamp, value double")


def test_buckets(spark):
    points = series(spark, a=[1, 5, 3, 2, 4])
    got = {how: ts.buckets(points, ["url"], "month", how).first().value for how in ("min", "max", "avg", "first", "last")}
    assert got == {"min": 1, "max": 5, "avg": 3, "first": 1, "last": 4}
    assert ts.buckets(points, ["url"], "day", "avg").count() == 5 and ts.buckets(points, ["url"], "week", "max").agg(F.sum("raw_count")).first()[0] == 5
    assert ts.buckets(series(spark, a=[1]).withColumn("ts", F.lit("2024-01-05 12:00:00").cast("timestamp")), ["url"], "month", "max").first().bucket == dt.datetime(2023, 12, 19)


def test_trends_and_predictions(spark):
    points = series(spark, up=range(1, 11), down=[10, 9, 8, 7, 6, 5], flat=[50] * 20, short=[1, 2], alternating=[10, 11] * 10, drop=[100 - 5 * i for i in range(10)], linear=[1, 2, 3, 4, 5])
    found = {r.url: r for r in ts.trends(points, ["url"]).collect()}
    assert found["up"].direction == "increasing" and abs(found["up"].slope - 1) < 1e-9 and found["up"].r2 > 0.9
    assert found["down"].direction == found["drop"].direction == "decreasing"
    assert not {"flat", "short", "alternating"} & set(found)
    ahead = {r.url: r.predicted for r in ts.predictions(points, ["url"], 3).collect()}
    assert abs(ahead["drop"] - 40) < 1e-6 and abs(ahead["flat"] - 50) < 1e-9 and "short" not in ahead
    assert abs({r.url: r.predicted for r in ts.predictions(points, ["url"], 1).collect()}["linear"] - 6) < 1e-9


def test_anomalies(spark):
    spike = [10] * 20
    spike[10] = 100
    got = ts.anomalies(series(spark, spike=spike, flat=[50] * 20, few=[1, 1, 1, 99]), ["url"]).collect()
    assert [(r.url, r.value) for r in got] == [("spike", 100.0)]


def plain_autocorrelation(v):
    v = np.asarray(v, dtype=float)
    n, c = len(v), np.asarray(v, dtype=float) - np.mean(v)
    var = (c * c).mean()
    best = None
    for k in range(2, n // 2):
        r = round((c[: n - k] * c[k:]).sum() / ((n - k) * var), 12)
        if best is None or r > best[1]:
            best = (k, r)
    return best if best and best[1] >= 0.5 else None


def test_periodicity(spark):
    weekly = [100 if i % 7 == 0 else 50 for i in range(28)]
    noise = np.random.default_rng(1).normal(size=40).tolist()
    got = {r.url: r for r in ts.periodicity(series(spark, weekly=weekly, noise=noise, short=[1, 2, 1, 2], wave=[np.sin(i / 2) for i in range(60)], flat=[3] * 30), ["url"]).collect()}
    assert got["weekly"].lag == 7 and abs(got["weekly"].period_seconds - 6.75 * 86400) < 1e-6 and 0 <= got["weekly"].phase < 1
    assert "short" not in got and "flat" not in got
    for name, values in (("weekly", weekly), ("noise", noise), ("wave", [np.sin(i / 2) for i in range(60)])):
        want = plain_autocorrelation(values)
        assert (name in got) == (want is not None) and (want is None or (got[name].lag == want[0] and abs(got[name].strength - want[1]) < 1e-9))
    kinds = {r.kind for r in ts.patterns(series(spark, weekly=weekly), ["url"]).collect()}
    assert "periodic" in kinds


RULES = "id string, domain string, field string, condition string, threshold double, active boolean"
WATCH = [("value_below", 80.0, 100, 75, True), ("value_above", 150.0, 100, 200, True), ("value_below", 80.0, 95, 100, False), ("change_by_percent", 0.1, 100, 80, True), ("available", 0.0, 0, 1, True), ("available", 0.0, 1, 0, False)]


@pytest.mark.parametrize("kind,threshold,before,now,fired", WATCH)
def test_watch_rules(spark, kind, threshold, before, now, fired):
    rules = spark.createDataFrame([("r", "d", "f", kind, threshold, True), ("off", "d", "f", kind, threshold, False), ("other", "d", "g", kind, threshold, True)], RULES)
    got = ts.alerts(series(spark, a=[before, now]), rules).collect()
    assert [r.id for r in got] == (["r"] if fired else [])


def test_new_instance_and_changes(spark):
    rules = spark.createDataFrame([("n", "d", "f", "new_instance", 0.0, True)], RULES)
    assert ts.alerts(series(spark, a=[5, 6], b=[7]), rules).count() == 2
    changed = ts.changes(series(spark, a=[1, 1, 2]), ["url"]).orderBy("ts").collect()
    assert [(r.old_value, r.new_value) for r in changed] == [(None, 1.0), (1.0, 2.0)]
    assert [r.value for r in ts.history(series(spark, a=[1, 2, 3], b=[9]), url="a", since=START).collect()] == [2.0, 3.0]
    assert ts.compare_history(series(spark, a=[1], b=[2], c=[3]), [("d", "a"), ("d", "c")], "f").count() == 2
    assert ts.value_ago(series(spark, a=[1, 2, 3]), ["url"], START + dt.timedelta(days=2), 1).first().value == 2.0


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 5, "five"), ("k", 7, "seven")], "k string, s int, v string")
    got = {(r.k, r.t): r.asof_v for r in ts.as_of(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("k", 1): None, ("k", 5): "five", ("k", 9): "seven", ("z", 3): None}


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_alert_stream_keeps_state_between_batches(spark, tmp_path):
    rules = spark.createDataFrame([("low", "d", "f", "value_below", 80.0, True), ("new", "d", "f", "new_instance", 0.0, True)], RULES)
    source = str(tmp_path / "points")
    schema = series(spark, a=[1]).schema
    series(spark, a=[100, 95]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = feeds.alert_stream(stream, rules).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    assert [r.id for r in spark.table("alerts").collect()] == ["new"]
    series(spark, a=[75]).withColumn("ts", F.lit("2024-02-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    drain(query)
    assert [(r.id, r.before, r.value) for r in spark.table("alerts").where("id = 'low'").collect()] == [("low", 95.0, 75.0)]


def test_bucket_stream_closes_windows_behind_the_watermark(spark, tmp_path):
    source = str(tmp_path / "points")
    schema = series(spark, a=[1]).schema
    series(spark, a=list(range(10))).write.parquet(source)
    stream = feeds.bucket_stream(spark.readStream.schema(schema).parquet(source), ["url"], "day", "1 day")
    drain(stream.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start())
    got = spark.table("buckets").orderBy("bucket").collect()
    assert 7 <= len(got) < 10 and all(r.low == r.high == r.mean and r.n == 1 for r in got)


def test_event_feed(spark, tmp_path):
    rows = [("page", "a.com", START, "{}"), ("page", "b.com", START, "{}"), ("runtime_started", None, START, "{}")]
    spark.createDataFrame(rows, feeds.EVENTS).write.json(str(tmp_path / "in"))
    query = feeds.append_to(feeds.for_domain(feeds.event_feed(spark, str(tmp_path / "in")), "a.com"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert {r.type for r in spark.read.json(str(tmp_path / "out")).collect()} == {"page", "runtime_started"}


def test_drained_streams_do_not_pass_through_the_driver(spark):
    from meshquery import catalog_queries

    sf = "/root/testdata/sf0.001"
    for name in ("stream_alerts", "stream_bucket_day"):
        out = catalog_queries.queries()[name](spark, sf)
        assert out.count() > 0 and out.inputFiles() and all(x.endswith(".parquet") for x in out.inputFiles())
