"""Operators without a bound on a group, against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquery.operators import ranks, timeseries

START = dt.datetime(2024, 1, 1)


def plain_periodicity(values):
    n = len(values)
    c = values - values.mean()
    if n < 7 or (c * c).mean() < 1e-6:
        return None
    best = max(((round(float((c[: n - k] * c[k:]).sum() / ((n - k) * (c * c).mean())), 12), -k) for k in range(2, n // 2)), default=(0, 0))
    return (-best[1], best[0]) if best[0] >= 0.5 else None


def test_periodicity_by_blocks(spark):
    rng = np.random.default_rng(2)
    series = {}
    for k, (n, period) in enumerate([(5000, 37), (3000, 500), (2049, 3), (100, 10), (257, 100), (6, 2), (700, 0), (1500, 700)]):
        series[k] = np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(0, 0.2, n) if period else rng.normal(0, 1, n)
    series[20] = np.ones(900)
    rows = [(k, START + dt.timedelta(seconds=60 * i), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k int, ts timestamp, value double").repartition(5)
    want = {k: plain_periodicity(v) for k, v in series.items()}
    for block in (64, 256, 1 << 16):
        got = {r.k: r for r in timeseries.periodicity(frame, ["k"], block).collect()}
        assert {k for k, v in want.items() if v} == set(got)
        for k, r in got.items():
            assert r.lag == want[k][0] and r.strength == pytest.approx(want[k][1], abs=1e-9)
            last = START.timestamp() + 60 * (len(series[k]) - 1)
            assert r.period_seconds == pytest.approx(60 * (len(series[k]) - 1) / len(series[k]) * r.lag)


def test_a_null_key_is_a_series(spark):
    rows = [(None if i % 2 else "a", START + dt.timedelta(hours=i), float(i // 2 % 4)) for i in range(400)]
    got = timeseries.periodicity(spark.createDataFrame(rows, "k string, ts timestamp, value double"), ["k"], 64).collect()
    assert sorted((str(r.k), r.lag) for r in got) == [("None", 4), ("a", 4)]


def test_ranks_of_huge_groups_spread_over_tasks(spark):
    rows = [(i % 2 if i % 50 else None, (i * 7919) % 1000, i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "g int, v int, i int")
    got = ranks.ranked(frame, ["g"], [F.desc("v"), F.asc("i")]).collect()
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((-v, i))
    want = {(g, i): at for g, members in groups.items() for at, (_, i) in enumerate(sorted(members))}
    assert {(r.g, r.i): r["rank"] for r in got} == want and len(got) == 5000
    assert ranks.first_rows(frame, ["g"], [F.asc("i")], 3).count() == 9
    same = spark.createDataFrame([(1,)] * 300, "g int")
    assert sorted(r["rank"] for r in ranks.ranked(same, ["g"], []).collect()) == list(range(300))
    assert ranks.ranked(frame.limit(0), ["g"], [F.asc("i")]).count() == 0


def dijkstra(edges, source, mode, avoid):
    import heapq

    best, heap = {source: (0, 0)}, [((0, 0), source)]
    while heap:
        label, node = heapq.heappop(heap)
        if label > best[node]:
            continue
        for s, t, w, f in edges:
            if s != node or s == t or (avoid and f & 1):
                continue
            step = {"hops": 1, "weight": w, "state_changes": 10 if f & 4 else 1}[mode]
            new = (label[0] + step, label[1] + 1)
            if new < best.get(t, (1 << 60, 0)):
                best[t] = new
                heapq.heappush(heap, (new, t))
    return best


@pytest.mark.parametrize(("mode", "avoid", "delta"), [("weight", (), 2), ("weight", (), None), ("hops", ("requires_auth",), None), ("state_changes", ("requires_auth",), 5)])
def test_paths_against_dijkstra(spark, mode, avoid, delta):
    from meshquery.operators import paths

    rng = np.random.default_rng(8)
    sites = {"a": [(int(rng.integers(25)), int(rng.integers(25)), int(rng.integers(0, 6)), int(rng.integers(8))) for _ in range(70)], "b": [(i, i + 1, i % 3, 0) for i in range(12)]}
    edges = spark.createDataFrame([(d, *e) for d, es in sites.items() for e in es], "domain string, src int, dst int, weight int, flags int")
    asked = [("a", 0, 5), ("a", 0, 24), ("a", 3, 3), ("a", 7, 1), ("b", 2, 12), ("b", 12, 2), ("b", 0, 0), ("none", 1, 2), ("a", 0, 5)]
    pairs = spark.createDataFrame(asked, "domain string, source int, target int")
    all_costs = {(r.domain, r.source, r.node): (r.cost, r.hops) for r in paths.costs(paths.steps_of(edges, mode, avoid), pairs.drop("target"), delta).collect()}
    want = {(d, s, n): label for d, s, _ in asked for n, label in dijkstra(sites.get(d, []), s, mode, avoid).items()}
    assert all_costs == want
    found = {(r.domain, r.source, r.target): r for r in paths.pathfind(edges, pairs, mode, avoid, delta).collect()}
    assert set(found) == {p for p in asked if p in want}
    for (d, s, t), r in found.items():
        assert (r.cost, r.hops) == want[d, s, t] and r.nodes[0] == s and r.nodes[-1] == t and len(r.nodes) == r.hops + 1
        steps = {}
        for a, b, w, f in sites.get(d, []):
            if not (avoid and f & 1):
                c = {"hops": 1, "weight": w, "state_changes": 10 if f & 4 else 1}[mode]
                steps[a, b] = min(c, steps.get((a, b), c))
        assert sum(steps[a, b] for a, b in zip(r.nodes, r.nodes[1:], strict=False)) == r.cost


def test_paths_of_nothing(spark):
    from meshquery.operators import paths

    edges = spark.createDataFrame([("a", 1, 2, 1, 0)], "domain string, src int, dst int, weight int, flags int")
    none = spark.createDataFrame([], "domain string, source int, target int")
    assert paths.pathfind(edges, none).count() == 0 and paths.pathfind(edges.limit(0), spark.createDataFrame([("a", 1, 2)], "domain string, source int, target int")).count() == 0


def test_work_per_row_is_dealt_to_all_tasks(spark):
    from meshquery import catalog_queries, operator_queries  # noqa: F401

    for name in ("images_compared", "features_merged"):
        assert catalog_queries.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_images_of_unlike_sizes(spark):
    from meshquery.operators import vector

    images = {1: ([[1] * 20] * 12, [[1] * 20] * 12), 2: ([[0] * 16] * 16, [[255] * 16] * 16), 3: ([[0] * 40] * 30, [[0] * 20 + [99] * 20] * 30)}
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in images.items()], "key int, a array<array<int>>, b array<array<int>>")
    got = {r.key: (r.similarity, r.changed, [tuple(x) for x in r.regions]) for r in vector.image_diffs(pairs).collect()}
    assert got == {k: (*(d := vector.pixel_diff(np.array(a), np.array(b)))[:2], [tuple(x) for x in d[2]]) for k, (a, b) in images.items()}


def test_pages_of_one_site_are_dealt_before_their_beginnings_are_made(spark):
    from meshquery import scale_queries

    plan = scale_queries.rules_of_one_site(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
