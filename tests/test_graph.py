import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquery.catalog import EDGE_FLAGS, EDGE_TYPE, NODE_FLAGS, PAGE_TYPE
from meshquery.operators import delta, graph, observations, paths, schema, vector

EDGES = "domain string, src int, dst int, edge_type int, weight int, flags int"
NODES = "domain string, node_id int, url string, page_type int, confidence int, flags int, features array<float>"


def edges(spark, rows):
    return spark.createDataFrame([("s", a, b, 1, w, f) for a, b, w, f in rows], EDGES)


def nodes(spark, rows):
    out = []
    for i, url, kind, flags, dims in rows:
        features = [0.0] * 128
        for k, v in dims.items():
            features[k] = float(v)
        out.append(("s", i, url, PAGE_TYPE[kind], 200, flags, features))
    return spark.createDataFrame(out, NODES)


def test_paths_by_hand(spark):
    e = edges(spark, [(0, 1, 1, 0), (1, 2, 1, 0), (2, 3, 1, 0), (0, 4, 5, 0), (4, 3, 5, 0)])
    assert [(r.cost, r.path) for r in graph.shortest_paths(e, 0, 3).collect()] == [(3, [0, 1, 2, 3])]
    assert [(r.cost, r.path) for r in graph.shortest_paths(e, 0, 3, "hops").collect()] == [(2, [0, 4, 3])]
    assert graph.shortest_paths(e, 0, 0).first().cost == 0 and graph.shortest_paths(e, 0, 99).count() == 0
    auth = edges(spark, [(0, 1, 1, EDGE_FLAGS["requires_auth"]), (0, 2, 1, EDGE_FLAGS["changes_state"]), (2, 1, 1, 0)])
    assert graph.shortest_paths(auth, 0, 1, avoid=("requires_auth",)).first().path == [0, 2, 1]
    assert graph.shortest_paths(auth, 0, 1, "state_changes").first().cost == 1


def test_paths_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(2):
        rows = [(rng.randrange(30), rng.randrange(30), rng.randint(1, 9), 0) for _ in range(90)]
        out = {r.node: r.cost for r in graph.shortest_paths(edges(spark, rows), 0).collect()}
        best, heap = {}, [(0, 0)]
        while heap:
            c, x = heapq.heappop(heap)
            if x not in best:
                best[x] = c
                for a, b, w, _ in rows:
                    if a == x:
                        heapq.heappush(heap, (c + w, b))
        assert out == best


def test_filters(spark):
    n = nodes(spark, [(0, "/", "home", 0, {}), *[(i, f"/p/{i}", "product_detail", NODE_FLAGS["has_price"] | (NODE_FLAGS["blocked"] if i == 5 else 0), {48: (50 + 30 * i) / 1000, 52: 0.6}) for i in range(1, 6)], *[(i, f"/a/{i}", "article", 0, {}) for i in range(6, 9)]])
    assert graph.filter_nodes(n, ["product_detail"]).count() == 5
    assert graph.filter_nodes(n, ["product_detail", "article"], require=("has_price",), exclude=("blocked",)).count() == 4
    got = graph.filter_nodes(n, ranges=[(48, 0.08, 0.14), (200, 9, 9)], sort=(48, True), limit=2).collect()
    assert [r.node_id for r in got] == [3, 2] and abs(got[0].confidence_share - 200 / 255) < 1e-9
    assert graph.parse_filter("48<300") == (48, None, 300.0) and graph.parse_filter("52>0.8") == (52, 0.8, None)


def plain_kmeans(x, k, rounds=20):
    n = len(x)
    c = np.stack([x[i * n // k] for i in range(k)])
    for _ in range(rounds):
        own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c, rtol=0, atol=1e-12):
            break
        c = new
    return ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 1, (30, 4)) for m in (0, 8, 20)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = {r.i: r.cluster for r in graph.kmeans(rows, "i", "v", 5)[0].collect()}
    assert [got[i] for i in range(90)] == plain_kmeans(x, 5).tolist()
    assert graph.cluster_count(20) == 6 and graph.cluster_count(1000) == 10 and graph.kmeans(rows.limit(0), "i", "v")[0].count() == 0
    means = graph.centroids(rows, "i", "v").where("i = 3").first().centroid
    assert np.allclose(means, x[3])


def test_edges_from_urls_and_links(spark):
    n = nodes(spark, [(0, "http://h/", "home", 0, {}), (1, "http://h/a", "article", 0, {}), (2, "http://h/a/x", "article", 0, {}), (3, "http://h/a/y/", "article", 0, {})])
    got = {(r.src, r.dst): r.weight for r in graph.path_edges(n).collect()}
    assert got[(0, 2)] == 2 and got[(2, 0)] == 3 and got[(1, 2)] == 2 and got[(3, 1)] == 3 and got[(2, 3)] == got[(3, 2)] == 1
    links = spark.createDataFrame([("s", 0, "http://h/a"), ("s", 1, "http://h/a"), ("s", 0, "http://nowhere/")], "domain string, src int, url string")
    assert {(r.src, r.dst, r.weight) for r in graph.link_edges(links, n).collect()} == {(0, 1, 1), (1, 0, 2)}
    crumbs = spark.createDataFrame([("s", "p", i, i) for i in range(3)], "domain string, page string, position int, node_id int")
    assert {(r.src, r.dst) for r in graph.crumb_edges(crumbs).collect()} == {(0, 1), (1, 2)}
    built = {r.node_id: r for r in graph.built(n, edges(spark, [(0, 1, 1, 0), (0, 2, 1, 0)])).collect()}
    assert (built[0].outbound_count, built[1].inbound_count, built[3].inbound_count) == (2, 1, 0)


def test_relationships(spark):
    n = spark.createDataFrame([("s", i, "Category" if i < 2 else "Product") for i in range(7)], "domain string, node_id int, model string")
    e = edges(spark, [(0, i, 1, 0) for i in range(2, 7)])
    got = graph.relationships(n, e).collect()
    assert [(r.from_model, r.to_model, r.name, r.cardinality, r.edge_count) for r in got] == [("Category", "Product", "has_products", "has_many", 5)]
    back = graph.relationships(n, e.unionByName(edges(spark, [(i, 0, 1, 0) for i in range(2, 7)]))).collect()
    assert {(r.name, r.cardinality) for r in back} == {("products", "many_to_many"), ("belongs_to_category", "belongs_to")}
    same = edges(spark, [(2, 3, 1, 0)])
    assert graph.relationships(n, same).count() == 0
    assert graph.relationships(n, same.selectExpr("domain", "src", "dst", f"{EDGE_TYPE['related']} AS edge_type", "weight", "flags")).first().name == "similar_to"


def test_render_order_and_refresh(spark):
    n = nodes(spark, [(0, "http://h/", "home", 1, {}), (1, "http://h/a", "article", 0, {}), (2, "http://h/a/b/c", "article", 0, {})]).selectExpr("*", "node_id AS inbound_count", "100 AS freshness")
    assert [r.node_id for r in graph.render_order(n, 5).collect()] == [1, 2]
    assert graph.refresh_set(n, [1]).count() == 1 and graph.refresh_set(n, below=0.3).count() == 0 and graph.refresh_set(n).count() == 3
    assert graph.diverse_sample(n, 2).select("page_type").distinct().count() == 2


def test_delta_and_application(spark):
    one = nodes(spark, [(0, "p1", "product_detail", 0, {48: 100}), (1, "gone", "article", 0, {})])
    two = nodes(spark, [(0, "p1", "product_detail", 0, {48: 89.99}), (2, "p2", "product_detail", 0, {48: 5, 52: 1})])
    assert delta.node_delta(one, one).count() == 0
    got = {r.url: r for r in delta.node_delta(one, two).collect()}
    assert got["p1"].op == "modify" and list(got["p1"].dims) == [48] and got["p2"].op == "add" and set(got["p2"].dims) == {48, 52} and got["gone"].op == "remove"
    after = {r.url: r.features for r in delta.apply_delta(one, delta.node_delta(one, two)).collect()}
    assert after == {r.url: r.features for r in two.collect()}
    ea, eb = edges(spark, [(0, 1, 1, 0), (0, 1, 1, 0), (1, 2, 1, 0)]), edges(spark, [(0, 1, 1, 0), (2, 0, 1, 0)])
    assert {(r.src, r.dst, r.op) for r in delta.edge_delta(ea, eb).collect()} == {(1, 2, "edge_remove"), (2, 0, "edge_add")}


def test_privacy_and_registry(spark, tmp_path):
    n = nodes(spark, [(0, "a", "home", NODE_FLAGS["auth_required"], {48: 5}), (1, "b", "home", 0, {48: 5, 88: 1, 112: 1, 127: 1})])
    got = {r.url: [i for i, v in enumerate(r.features) if v] for r in delta.stripped(n).collect()}
    assert got == {"a": [], "b": [48]}
    registry = delta.Registry(spark, str(tmp_path / "r"))
    registry.push(n)
    other = n.selectExpr("'t' AS domain", *[c for c in n.columns if c != "domain"])
    registry.push(other, spark.createDataFrame([("t", "2024-01-01 00:00:00"), ("t", "2024-02-01 00:00:00")], "domain string, ts string").selectExpr("domain", "timestamp(ts) AS ts"))
    assert registry.pull("s").count() == registry.pull("t").count() == 2 and {r.domain: r.nodes for r in registry.sites().collect()} == {"s": 2, "t": 2}
    import datetime as dt

    assert registry.deltas_since("t", dt.datetime(2024, 1, 1)).count() == 1
    assert delta.keep_last(registry.pull(), ["domain"], 1, "node_id").count() == 2


def test_cosine_edge_cases(spark):
    pairs = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    from pyspark.sql import functions as F

    got = [round(r.c, 9) for r in df.select("i", vector.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]


def test_nearest(spark):
    rows = [(i, [1.0 if j == i else 0.1 if j == 0 else 0.0 for j in range(5)]) for i in range(5)] + [(9, [0.0] * 5)]
    df = spark.createDataFrame(rows, "node_id int, features array<float>").selectExpr("'s' AS domain", "*")
    assert vector.nearest(df, [0.1, 0, 1, 0, 0], 2).first().node_id == 2
    assert vector.nearest(df, [0.0] * 5, 2).count() == 0
    assert vector.nearest(df, [1.0, 0, 0, 0, 0], 6).collect()[-1].similarity == -1.0
    assert [r.node_id for r in vector.similar_to(df, "node_id", 2, 2).collect()][0] != 2


def test_pixels():
    a = np.zeros((100, 100), dtype=np.uint8)
    assert vector.pixel_diff(a, a) == (1.0, 0.0, [])
    b = a.copy()
    b[10:30, 60:90] = 255
    similarity, share, regions = vector.pixel_diff(a, b)
    assert abs(share - 0.06) < 1e-9 and similarity < 1 and len(regions) == 1
    assert vector.pixel_diff(a, np.full((50, 80), 255, dtype=np.uint8))[0] == 0.0


def test_image_diffs(spark):
    df = spark.createDataFrame([(1, [[0, 0], [0, 0]], [[0, 0], [255, 255]])], "key int, a array<array<int>>, b array<array<int>>")
    assert vector.image_diffs(df).first().changed == 0.5


def test_merged_features(spark):
    from pyspark.sql import functions as F

    a, b = [0.0] * 128, [0.0] * 128
    a[0], b[1], a[2], b[2] = 1.0, 2.0, 3.0, 4.0
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    got = lambda x, y: df.select(vector.merged_features(F.col("a"), F.col("b"), F.lit(x), F.lit(y)).alias("m")).first().m[:4]
    assert got(0.5, 0.5) == [1.0, 2.0, 4.0, 0.0] and got(0.9, 0.5) == [1.0, 2.0, 3.0, 0.0]


def test_schema_inference(spark):
    rows = [(0, "/", "home", 0, {}), *[(i, f"/p/{i}", "product_detail", 0, {48: 10 + i, 52: 0.8, 51: 0 if i % 3 == 0 else 1, 50: 0.3, 13: 1, 53: 0.46}) for i in range(1, 11)], *[(i, f"/a/{i}", "article", 0, {17: 0.5}) for i in range(11, 16)], (20, "/cart", "cart", 0, {})]
    n = nodes(spark, rows)
    found = {r.model: r.instances for r in schema.models(n).collect()}
    assert found["Product"] == 10 and found["Article"] == 5 and found["Cart"] == 1
    product = {r.field: r for r in schema.fields(n).where("model = 'Product'").collect()}
    assert {"url", "node_id", "price", "rating", "brand", "sku"} <= set(product) and product["availability"].nullable and not product["price"].nullable
    assert product["review_count"].examples == ["98"] or int(product["review_count"].examples[0]) in range(95, 102)
    assert "price DOUBLE" in schema.ddl(schema.fields(n), "Product") and schema.totals(n).first().models == len(found)


def test_unify_and_overlap(spark):
    df = spark.createDataFrame([("a", "P", "cost"), ("b", "P", "price"), ("b", "P", "sku")], "domain string, type string, field string")
    got = {r.field: r.coverage for r in schema.unified_fields(df).collect()}
    assert got == {"price": 1.0, "sku": 0.5}
    assert [tuple(r) for r in schema.site_overlap(df, "domain", "field").collect()] == []
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "s string, i int")
    assert [tuple(r) for r in schema.site_overlap(items, "s", "i").collect()] == [("a", "b", 1, 0.333)]
    assert {r.i for r in schema.unique_items(items, "s", "i").collect()} == {1, 3, 9} and schema.common_items(items, "s", "i").count() == 0


def test_observations(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i), i % 2, ["a", "b"] if i % 3 else ["c"], [1.0, float(i)], None) for i in range(10)]
    log = spark.createDataFrame(rows, "id bigint, ts timestamp, session_id int, labels array<string>, embedding array<float>, memory_link bigint")
    assert [r.id for r in observations.query(log, [1], at, at + dt.timedelta(hours=5), ["c"]).collect()] == [3]
    assert [r.id for r in observations.recent(log, 2).collect()] == [9, 8] and observations.by_session(log, 0).count() == 5
    assert observations.in_range(log, at, at + dt.timedelta(hours=2)).count() == 3
    assert observations.linked(log, 4, 77).where("id = 4").first().memory_link == 77
    assert observations.stats(log).first().next_id == 10 and observations.similar(log, [1.0, 0.0], 3, 0.9).first().id == 0
    assert {r.id for r in observations.tracked(log, 0.9).collect()} == {2, 3}


@pytest.mark.parametrize("name", ["weight", "hops"])
def test_site_graph(spark, name):
    g = graph.SiteGraph(nodes(spark, [(0, "/", "home", 0, {1: 1}), (1, "/a", "article", 0, {2: 1})]), edges(spark, [(0, 1, 3, 0)]))
    assert g.pathfind(0, 1, mode=name).count() == 1 and g.filter(page_types=["home"]).count() == 1 and g.node(1).count() == 1


def cheapest(links, source):
    out, best, heap = {}, {}, [(0, source)]
    for a, b, w in links:
        out.setdefault(a, []).append((b, w))
    while heap:
        c, x = heapq.heappop(heap)
        if x not in best:
            best[x] = c
            for b, w in out.get(x, ()):
                heapq.heappush(heap, (c + w, b))
    return best


def test_path_queries_over_whole_link_tables(spark, tmp_path):
    from meshquery import catalog_queries

    orders = [(o, o * 7 % 5 + 1) for o in range(1, 41)]
    lines = [(o, (o * k) % 9 + 1, (o + k) % 4 + 1) for o, _ in orders for k in (1, 3, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: {r.node: r.cost for r in catalog_queries.queries()[name](spark, str(tmp_path)).collect()}
    both = lambda pairs: [x for a, b in pairs for x in ((a, b), (b, a))]
    assert run("shortest_path_all") == cheapest([(a, b, 1) for a, b in both((c * 2, o * 2 + 1) for o, c in orders)], 2)
    pairs = {(o * 4, c * 4 + 1) for o, c in orders} | {(o * 4, p * 4 + 2) for o, p, _ in lines} | {(p * 4 + 2, s * 4 + 3) for _, p, s in lines}
    want = cheapest([(a, b, 1 + (a * 7 + b) % 5) for a, b in both(pairs)], 4)
    assert run("shortest_path_weighted_all") == want and len(want) == 40 + 5 + 9 + 4


def test_rounds_join_links_without_a_shuffle_or_a_sort_of_them(spark):
    edges = spark.range(4).selectExpr("'a' AS domain", "id AS src", "id + 1 AS dst", "0 AS flags", "1 AS weight")
    asked = spark.createDataFrame([("a", 0)], "domain string, source long")
    steps = paths.kept(paths.steps_of(edges.unionByName(edges.withColumn("domain", F.lit("b"))), "weight"), asked)
    assert {r.domain for r in steps.select("domain").distinct().collect()} == {"a"}
    front = graph.written(spark.range(4).selectExpr("id AS src", "'a' AS domain"))
    with graph.in_order(spark):
        plan = front.hint("merge").join(steps, ["src", "domain"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
    assert paths.costs(steps, asked).where("node = 4 AND cost = 4").count() == 1


def test_links_are_in_order_before_they_are_written_to_buckets(spark):
    # the write's own sort works out a bucket's number for every comparison, so rows must come to it sorted, and links are not grouped before
    status = spark._jsparkSession.sharedState().statusStore()
    before = status.executionsCount()
    links = spark.range(2000).selectExpr("'a' AS domain", "id % 50 AS src", "id % 7 AS dst", "id + 1 AS weight", "0 AS flags")
    steps = paths.kept(paths.steps_of(links, "weight", once=False), spark.createDataFrame([("a", 3)], "domain string, source long"))
    told = [status.executionsList(i, 1).apply(0).physicalPlanDescription() for i in range(before, status.executionsCount())]
    (plan,) = [p for p in told if "Bucketed: true" not in p and "CreateDataSourceTableAsSelect" in p]
    assert re.search(r"Arguments: \[src#\d+L? ASC", plan), plan
    assert "HashAggregate" not in plan and steps.count() == sum(1 for i in range(2000) if i % 50 != i % 7)
    got = {(r.source, r.node): r.cost for r in paths.costs(steps, spark.createDataFrame([("a", 3)], "domain string, source long")).collect()}
    want = {(r.source, r.node): r.cost for r in paths.costs(paths.steps_of(links, "weight"), spark.createDataFrame([("a", 3)], "domain string, source long")).collect()}
    assert got == want and len(got) > 5


def test_rows_that_compress_well_stay_dealt(spark):
    from meshquery import catalog_queries, operator_queries  # noqa: F401

    rows = spark.range(0, 40_000, 1, 4).select(F.lit("s").alias("domain"), F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    # a grouping of numbers that rise: by compressed bytes Spark would give all to a few tasks
    assert catalog_queries.dealt(rows, "src", "dst", each=1000).distinct().rdd.getNumPartitions() >= 40
    sf = "/root/testdata/sf0.001"
    for query in (catalog_queries.queries()["degrees"], catalog_queries.queries()["linked_pages"], lambda s, d: catalog_queries._trade_graph(s, d)[1]):
        assert "REPARTITION_BY_NUM" in query(spark, sf)._jdf.queryExecution().executedPlan().toString()
