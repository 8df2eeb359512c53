"""Queries of the operators that have no bound on a group: long series, ranks, paths of many sources, trees of hashes, longest prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_queries, operator_queries  # noqa: F401
from .catalog import PAGE_TYPE
from .catalog_queries import _query, _sql, spread, table
from .functions import urls
from .operators import compiled, graph, hash_tree, paths, ranks, timeseries
from .sources import html_data, json_data, site_files, site_source, xml_files
from .streaming import feeds

_LAGS = """
    s AS (SELECT k, i, t, v - avg(v) OVER (PARTITION BY k) AS c, var_pop(v) OVER (PARTITION BY k) AS var, count(*) OVER (PARTITION BY k) AS n, min(t) OVER (PARTITION BY k) AS t0, max(t) OVER (PARTITION BY k) AS t1 FROM p),
    r AS (SELECT a.k, b.i - a.i AS lag, sum(a.c * b.c) / ((any_value(a.n) - (b.i - a.i)) * any_value(a.var)) AS strength, any_value(a.n) AS n, any_value(a.t0) AS t0, any_value(a.t1) AS t1
          FROM s a JOIN s b ON a.k = b.k AND b.i BETWEEN a.i + 2 AND a.i + a.n // 2 - 1 WHERE a.n >= 7 AND a.var >= 1e-6 GROUP BY a.k, b.i - a.i),
    b AS (SELECT k, arg_max(lag, (round(strength, 9), -lag)) AS lag, max(strength) AS strength, any_value(n) AS n, any_value(t0) AS t0, any_value(t1) AS t1 FROM r GROUP BY k)"""


@_query("periodicity_of_all", f"""
    WITH p AS (SELECT 0 AS k, row_number() OVER (ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6::DOUBLE AS t, value / 10 + event_id % 24 AS v FROM events), {_LAGS}
    SELECT lag::INT AS lag, round(strength, 6) AS strength, round((t1 - t0) / n * lag, 3) AS period, round(((t1 % ((t1 - t0) / n * lag)) / ((t1 - t0) / n * lag)), 4) AS phase FROM b WHERE strength >= 0.5""")
def periodicity_of_all(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.lit(0).alias("k"), "ts", (F.col("value") / 10 + F.col("event_id") % 24).alias("value"))
    return timeseries.periodicity(points, ["k"], block=256).select("lag", F.round("strength", 6).alias("strength"), F.round("period_seconds", 3).alias("period"), F.round("phase", 4).alias("phase"))


@_query("patterns_found", f"""
    WITH p AS (SELECT user_id % 6 AS k, row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6::DOUBLE AS t,
                      value / 10 + (user_id % 6) * (row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) - 1) % 12 + (CASE WHEN user_id % 6 = 1 THEN epoch_us(ts) / 1e6 / 8640 ELSE 0 END) AS v FROM events), {_LAGS},
    f AS (SELECT k, count(*) AS n, regr_r2(v, (t - t0) / 86400) AS r2, var_pop(v) AS vy FROM (SELECT *, min(t) OVER (PARTITION BY k) AS t0 FROM p) GROUP BY k),
    m AS (SELECT k, avg(v) AS mean, stddev_pop(v) AS spread FROM p GROUP BY k)
    SELECT k, 'trend' AS kind, 1::BIGINT AS n FROM f WHERE n >= 3 AND r2 >= 0.3
    UNION ALL SELECT k, 'periodic', 1 FROM b WHERE strength >= 0.5
    UNION ALL SELECT k, 'anomaly', count(*) FROM p JOIN m USING (k) WHERE abs(v - mean) / spread > 2 GROUP BY k""")
def patterns_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select((F.col("user_id") % 6).alias("k"), "ts", "event_id", "value")
    placed = ranks.ranked(events, ["k"], [F.asc("ts"), F.asc("event_id")], "i")
    rising = F.when(F.col("k") == 1, timeseries.seconds() / 8640).otherwise(0.0)
    points = placed.select("k", "ts", (F.col("value") / 10 + F.col("k") * F.col("i") % 12 + rising).alias("value"))
    return timeseries.patterns(points, ["k"]).groupBy("k", "kind").agg(F.count("*").alias("n"))


@_query("ranks_in_two_groups", """
    SELECT o_orderkey, o_orderkey % 2 AS side, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders""")
def ranks_in_two_groups(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("side"), "o_totalprice")
    return ranks.ranked(orders, ["side"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "side", "rank")


def _keyed(edges: str, start: str) -> str:
    """Cheapest costs by one recursion that keeps a row per node."""
    return f"""WITH RECURSIVE e AS (SELECT s, t, min(w) AS w FROM ({edges}) GROUP BY s, t),
    p(k, node, cost) USING KEY (k, node) AS ({start} UNION
        SELECT x.k, x.node, x.cost FROM (SELECT p.k, e.t AS node, min(p.cost + e.w) AS cost FROM p JOIN e ON p.node = e.s GROUP BY p.k, e.t) x
        LEFT JOIN recurring.p r ON r.k = x.k AND r.node = x.node WHERE r.cost IS NULL OR x.cost < r.cost)"""


_PART_LINKS = "SELECT s, t, CASE WHEN (s + t) % 4 = 0 THEN 10 ELSE 1 END AS w FROM (SELECT p_partkey AS s, unnest([p_partkey + 1, p_partkey + 40, p_partkey * 3]) AS t FROM part) WHERE t <= (SELECT max(p_partkey) FROM part) AND s * t % 11 <> 0"
_TRADE = "SELECT s, t, 1 + (s * 7 + t) % 5 AS w FROM (SELECT a AS s, b AS t FROM l UNION ALL SELECT b, a FROM l)"
_TRADE_LINKS = _TRADE.replace("FROM l", "FROM (SELECT o_orderkey * 4 AS a, o_custkey * 4 + 1 AS b FROM orders UNION ALL SELECT l_orderkey * 4, l_partkey * 4 + 2 FROM lineitem UNION ALL SELECT l_partkey * 4 + 2, l_suppkey * 4 + 3 FROM lineitem)")
_sql["shortest_state_changes"] = _keyed(_PART_LINKS, "SELECT 0, 1::BIGINT, 0") + " SELECT node::INT AS node, cost::BIGINT AS cost FROM p"
_sql["shortest_path_all"] = _keyed("SELECT o_custkey * 2 AS s, o_orderkey * 2 + 1 AS t, 1 AS w FROM orders UNION ALL SELECT o_orderkey * 2 + 1, o_custkey * 2, 1 FROM orders", "SELECT 0, (SELECT min(o_custkey) * 2 FROM orders), 0") + " SELECT node::INT AS node, cost::BIGINT AS cost FROM p"
_sql["shortest_path_weighted_all"] = _keyed(_TRADE_LINKS, "SELECT 0, (SELECT min(o_orderkey) * 4 FROM orders), 0") + " SELECT node::INT AS node, cost::BIGINT AS cost FROM p"


def _sited_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of orders, customers, parts and suppliers, both ways, on two sites; on the second one they cost twice as much."""
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("way")
    links = catalog_queries._trade_links(spark, d).select(ways).select("way.*")
    both = links.withColumn("domain", F.explode(F.array(F.lit("a"), F.lit("b"))))
    sum_, product = F.col("src") + F.col("dst"), F.col("src") * F.col("dst")
    flags = F.when(sum_ % 4 == 1, 4).otherwise(0) + F.when(product % 11 == 0, 1).otherwise(0)
    return both.withColumn("weight", ((1 + (F.col("src") * 7 + F.col("dst")) % 5) * F.when(F.col("domain") == "b", 2).otherwise(1)).cast("int")).withColumn("flags", flags)


@_query("path_costs_of_many", _keyed(_TRADE_LINKS, "SELECT x, x, 0 FROM (SELECT unnest([5, 9, 13])::BIGINT AS x)") + """
    SELECT unnest(['a', 'b']) AS domain, k AS source, node, unnest([cost, 2 * cost])::BIGINT AS cost FROM p""")
def path_costs_of_many(spark: SparkSession, d: str) -> DataFrame:
    """Weighted costs from three customers to everything, on two sites."""
    source = F.explode(F.array(*[F.lit(n).cast("long") for n in (5, 9, 13)])).alias("source")
    asked = spark.range(1).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("domain")).select("domain", source)
    return paths.costs(paths.steps_of(_sited_links(spark, d), "weight", once=False), asked).select("domain", "source", "node", "cost")


@_query("paths_found", _keyed(_TRADE_LINKS.replace("SELECT s, t, 1 + (s * 7 + t) % 5 AS w", "SELECT s, t, CASE WHEN (s + t) % 4 = 1 THEN 10 ELSE 1 END AS w") + " WHERE s * t % 11 <> 0", "SELECT x, x, 0 FROM (SELECT unnest([5, 9, 13])::BIGINT AS x)") + """
    SELECT 'a' AS domain, k AS source, node AS target, cost::BIGINT AS cost, true AS whole FROM p WHERE node % 4 = 3""")
def paths_found(spark: SparkSession, d: str) -> DataFrame:
    """Fewest state changes without logins from three customers to all suppliers; ``whole``: the path's own steps add up to its cost."""
    edges = _sited_links(spark, d)
    asked = table(spark, d, "supplier").select(F.lit("a").alias("domain"), F.explode(F.array(*[F.lit(n).cast("long") for n in (5, 9, 13)])).alias("source"), (F.col("s_suppkey") * 4 + 3).alias("target"))
    steps = paths.kept(paths.steps_of(edges, "state_changes", ("requires_auth",), once=False), asked)
    found = paths.paths_along(steps, asked)
    pairs = F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.struct(F.get("nodes", i - 1).alias("src"), F.get("nodes", i).alias("dst")))
    each = found.select("domain", "source", "target", "cost", F.explode(pairs).alias("x")).select("domain", "source", "target", "cost", "x.*")
    taken = each.join(steps, ["domain", "src", "dst"], "left").groupBy(*each.columns).agg(F.min("step").alias("step"))
    sums = taken.groupBy("domain", "source", "target").agg(F.first("cost").alias("cost"), F.sum("step").alias("sum"))
    return sums.select("domain", "source", "target", "cost", (F.col("sum") == F.col("cost")).alias("whole"))


@_query("registries_compared", """
    SELECT c_custkey::VARCHAR AS domain, CASE WHEN c_custkey % 101 = 1 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 101 = 1
    UNION ALL SELECT 'new' || c_custkey, 'added' FROM customer WHERE c_custkey % 89 = 2""")
def registries_compared(spark: SparkSession, d: str) -> DataFrame:
    """Two registries of a site per customer, compared through their trees of hashes."""
    key = F.col("c_custkey")
    old = table(spark, d, "customer").select(key.cast("string").alias("domain"), F.md5(F.concat_ws("|", "c_name", "c_acctbal")).alias("digest"), "c_custkey")
    new = old.where(key % 101 != 1).withColumn("digest", F.when(key % 97 == 0, F.md5("digest")).otherwise(F.col("digest"))).unionByName(old.where(key % 89 == 2).withColumn("domain", F.concat(F.lit("new"), "domain")))
    at = [graph.shared_path(spark, "registry") for _ in range(2)]
    hash_tree.write(old, at[0], 3)
    hash_tree.write(new, at[1], 3)
    return hash_tree.differences(spark, *at, 3)


def _ld_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per part with its JSON-LD in one of five shapes."""
    key, kinds = F.col("p_partkey"), list(html_data.LD_PAGES)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % len(kinds) + 1).cast("int"))
    price = F.format_string("%.2f", "p_retailprice")
    offer = lambda p: F.concat(F.lit('{"price":'), p, F.lit(',"priceCurrency":"EUR","availability":"https://schema.org/InStock"}'))
    quoted = F.concat(F.lit('"'), price, F.lit('"'))
    product = lambda o: F.concat(F.lit('{"@type":"Product","name":"'), "p_name", F.lit('","offers":'), o, F.lit(',"aggregateRating":{"ratingValue":"4.5","reviewCount":'), F.col("p_size").cast("string"), F.lit("}}"))
    other = F.concat(F.lit('{"@type":["'), kind, F.lit('","Thing"]}'))
    shapes = [product(offer(price)), F.concat(F.lit("["), product(offer(quoted)), F.lit(","), other, F.lit("]")), F.concat(F.lit('{"@context":"x","@graph":['), product(F.concat(F.lit("["), offer(price), F.lit("]"))), F.lit(","), other, F.lit("]}")), other, F.lit('{"@type":"Product"')]
    data = F.element_at(F.array(*shapes), (key % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("<head><script type='application/ld+json'>\n"), data, F.lit("</script></head>")).alias("html"))


@_query("products_in_json", """
    SELECT p_partkey, p_name AS name, round(p_retailprice, 2) AS price, 'EUR' AS currency, 'InStock' AS availability, 4.5::DOUBLE AS rating, p_size::BIGINT AS reviews FROM part WHERE p_partkey % 5 < 3""")
def products_in_json(spark: SparkSession, d: str) -> DataFrame:
    return json_data.products(_ld_pages(spark, d), "p_partkey")


@_query("page_types_in_json", """
    WITH k AS (SELECT ['product', 'article', 'newsarticle', 'blogposting', 'faqpage', 'aboutpage', 'contactpage', 'collectionpage', 'searchresultspage', 'itemlist', 'offerlist', 'checkoutpage', 'profilepage', 'mediagallery', 'imageobject', 'videoobject', 'discussionforumposting', 'review'] AS kinds,
                      [4, 5, 5, 5, 30, 28, 29, 2, 2, 3, 3, 9, 11, 14, 14, 14, 23, 16] AS codes)
    SELECT p_partkey, kinds[p_partkey % 18 + 1] AS kind, codes[p_partkey % 18 + 1]::INT AS page_type FROM part, k WHERE p_partkey % 5 BETWEEN 1 AND 3""")
def page_types_in_json(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("thing")
    return json_data.things(_ld_pages(spark, d), "p_partkey").where(F.get(F.split(json_data.text_at(t, "$['@type'][1]"), ","), F.lit(0)) == "Thing").select("p_partkey", json_data.kind_of(t).alias("kind"), json_data.page_type_of(t).alias("page_type"))


@_query("rules_of_one_site", """
    SELECT p_partkey, CASE WHEN p_partkey % 100 = 0 THEN true WHEN p_partkey % 10 = 7 THEN false WHEN (p_partkey // 10) % 3 = 1 THEN false ELSE true END AS allowed FROM part""")
def rules_of_one_site(spark: SparkSession, d: str) -> DataFrame:
    """A rule for every tenth of a site's paths and exact ones besides: as many rules as a site of parts has sections."""
    key = F.col("p_partkey")
    pages = spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", F.lit("shop.test").alias("domain"), F.concat(F.lit("https://shop.test/s"), F.floor(key / 10).cast("string"), F.lit("/p"), key.cast("string")).alias("url"))
    sections = table(spark, d, "part").select(F.floor(key / 10).alias("n")).distinct()
    rule = lambda kind, pattern: F.struct(F.lit("shop.test").alias("domain"), F.lit(kind).alias("kind"), F.concat(*pattern).alias("pattern"))
    n = F.col("n").cast("string")
    closed = sections.where(F.col("n") % 3 == 1).select(F.inline(F.array(rule("disallow", (F.lit("/s"), n, F.lit("/*"))))))
    sevens = sections.select(F.inline(F.array(rule("disallow", (F.lit("/s"), n, F.lit("/p"), (F.col("n") * 10 + 7).cast("string"), F.lit("$"))))))
    opened = sections.where(F.col("n") % 10 == 0).select(F.inline(F.array(rule("allow", (F.lit("/s"), n, F.lit("/p"), (F.col("n") * 10).cast("string"))))))
    return urls.robots_allowed(pages, closed.unionByName(sevens).unionByName(opened)).select("p_partkey", "allowed")


@_query("sitemap_files", """
    SELECT 'https://shop.test/p?a=1&b=' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN NULL ELSE '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS lastmod, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE p_size / 100.0 END::DOUBLE AS priority FROM part""")
def sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps of all parts, written as XML and read back by entries."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    day = F.when(size % 3 != 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    share = F.when(size % 2 != 0, F.concat(F.lit("<priority>"), (size / 100.0).cast("string"), F.lit("</priority>"))).otherwise("")
    line = F.concat(F.lit("<url>\n <loc>https://shop.test/p?a=1&amp;b="), key, F.lit("</loc>\n"), day, share, F.lit("</url>"))
    path = graph.shared_path(spark, "sitemaps")
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return xml_files.sitemap_files(spark, path).select("url", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "priority")


@_query("stream_alerts_late", """
    WITH l AS (SELECT event_type AS domain, user_id::VARCHAR AS url, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, value) AS before FROM events)
    SELECT CASE WHEN domain = 'click' THEN 'r1' ELSE 'r2' END AS id, domain, url, epoch_us(ts)::BIGINT AS at, before, value FROM l WHERE (domain = 'click' AND value > 50 AND before <= 50) OR (domain = 'view' AND value < 20 AND before >= 20)""")
def stream_alerts_late(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on events that arrive out of order in several batches: the same as those of the whole table."""
    path = graph.shared_path(spark, "arriving")
    events = table(spark, d, "events").select(F.col("event_type").alias("domain"), F.col("user_id").cast("string").alias("url"), F.lit("value").alias("field"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    last = events.agg(F.max("ts").alias("last"), F.max("event_id").alias("top"), F.count("*").alias("n")).first()
    rank = (F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(last.top // 10 + 1))) * 4 / F.lit(last.top * 1.11 + 1)  # late by up to a tenth
    for batch in range(4):
        events.where(F.floor(rank) == batch).drop("event_id").write.mode("append").parquet(path)
    for turn in range(2):  # the feed's end, twice: time passes, then what waited for it comes out
        spark.range(1).select(F.lit("end").alias("domain"), F.lit(str(turn)).alias("url"), F.lit("value").alias("field"), (F.lit(last.last) + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(0.0).alias("value")).write.mode("append").parquet(path)
    rules = spark.createDataFrame([("r1", "click", "value", "value_above", 50.0, True), ("r2", "view", "value", "value_below", 20.0, True)], "id string, domain string, field string, condition string, threshold double, active boolean")
    points = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = catalog_queries._drained(spark, feeds.alert_stream(points, rules, "200 days"), "append")
    return out.select("id", "domain", "url", F.unix_micros("ts").alias("at"), "before", "value")


def _next_links(pages: DataFrame, reach: int) -> DataFrame:
    """(domain, src, dst) from each page to those of its site that follow within ``reach`` numbers: they lie in its block of numbers or the
    one after, so no pair of a whole site is formed."""
    block = F.floor(F.col("node_id") / reach)
    near = pages.select("domain", F.col("node_id").alias("src"), F.explode(F.array(block, block + 1)).alias("block"))
    met = near.join(pages.select("domain", F.col("node_id").alias("dst"), block.alias("block")), ["domain", "block"])
    return met.where(f"dst > src AND dst <= src + {reach}").select("domain", "src", "dst")


def _written_sites(spark: SparkSession, d: str) -> str:
    """A site file per brand: its parts as pages, links to the next part of the brand by number, and one action per page."""
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("int")
    pages = part.select(F.col("p_brand").alias("domain"), key.alias("node_id"), F.concat(F.lit("/p/"), key.cast("string")).alias("url"), F.lit(4).alias("page_type"), (key % 256).alias("confidence"), (key % 7).alias("flags"), F.array_repeat((key % 10).cast("float"), 128).alias("features"), (key % 1000).alias("http_status"), (key % 5).alias("cluster"))
    links = _next_links(pages, 60).withColumns({"edge_type": F.lit(1), "weight": F.col("dst") - F.col("src"), "flags": F.lit(0)})
    acts = pages.select("domain", "node_id", F.lit(2).alias("category"), (F.col("node_id") % 3).alias("action"), F.lit(-1).alias("target_node"), F.lit(9).alias("cost_hint"), (F.col("node_id") % 2).alias("risk"))
    site_source.register(spark)
    path = graph.shared_path(spark, "sites")
    site_source.sites(pages, links, acts).write.format("sitefile").mode("append").save(path)
    return path


_PLACES = "n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)"


@_query("site_source_nodes", f"WITH {_PLACES} SELECT p_brand AS domain, i::INT AS node_id, '/p/' || p_partkey AS url, (p_partkey % 256)::INT AS confidence, (p_partkey % 7)::INT AS flags, (p_partkey % 1000)::INT AS http_status, (p_partkey % 5)::INT AS cluster, (p_partkey % 10)::DOUBLE AS first FROM n")
def site_source_nodes(spark: SparkSession, d: str) -> DataFrame:
    read = spark.read.format("sitefile").load(_written_sites(spark, d))
    return read.select("domain", "node_id", "url", "confidence", "flags", "http_status", "cluster", F.get("features", F.lit(0)).cast("double").alias("first"))


@_query("site_source_edges", f"WITH {_PLACES} SELECT a.p_brand AS domain, a.i::INT AS src, b.i::INT AS dst, (b.p_partkey - a.p_partkey)::INT AS weight FROM n a JOIN n b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_partkey <= a.p_partkey + 60")
def site_source_edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("sitefile").option("part", "edges").load(_written_sites(spark, d)).select("domain", "src", "dst", "weight")


@_query("site_source_actions", f"WITH {_PLACES} SELECT p_brand AS domain, i::INT AS node_id, 2 AS category, (p_partkey % 3)::INT AS action, -1 AS target_node, 9 AS cost_hint, (p_partkey % 2)::INT AS risk FROM n WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def site_source_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions of three sites: the filter is the reader's."""
    return spark.read.format("sitefile").option("part", "actions").load(_written_sites(spark, d)).where(F.col("domain").isin("Brand#1", "Brand#2", "Brand#3"))


@_query("actions_compiled", """
    WITH a(category, action, name, model, own) AS (VALUES (0, 0, 'click', 'Site', false), (0, 1, 'navigate', 'Site', false), (0, 2, 'scroll', 'Site', false), (0, 3, 'navigate', 'Site', false), (0, 4, 'navigate', 'Site', false),
        (1, 0, 'submit_form', 'Site', false), (1, 1, 'search', 'Site', false), (1, 2, 'filter', 'Site', false), (1, 3, 'sort', 'Site', false), (1, 4, 'submit', 'Site', false),
        (2, 0, 'add_to_cart', NULL, true), (2, 1, 'remove_from_cart', 'Cart', true), (2, 2, 'update_quantity', 'Cart', true), (2, 3, 'apply_coupon', 'Cart', false), (2, 4, 'checkout', 'Cart', false),
        (3, 0, 'login', 'Site', false), (3, 1, 'logout', 'Site', false), (3, 2, 'register', 'Site', false), (3, 3, 'auth_action', 'Site', false), (3, 4, 'auth_action', 'Site', false),
        (8, 0, 'action_08_00', NULL, false), (8, 1, 'action_08_01', NULL, false), (8, 2, 'action_08_02', NULL, false), (8, 3, 'action_08_03', NULL, false), (8, 4, 'action_08_04', NULL, false)),
    r(name, method, endpoint, params) AS (VALUES ('search', 'GET', '/search?q={query}', 'query'), ('add_to_cart', 'POST', '/cart/add', 'node_id,quantity'), ('remove_from_cart', 'POST', '/cart/remove', 'node_id'), ('apply_coupon', 'POST', '/cart/coupon', 'code'),
        ('checkout', 'POST', '/checkout', 'payment_method'), ('login', 'POST', '/auth/login', 'email,password'), ('filter', 'GET', '/filter', 'criteria'), ('sort', 'GET', '/sort', 'criteria')),
    p AS (SELECT p_brand AS domain, p_partkey, [0, 1, 2, 3, 8][p_size % 5 + 1] AS category, p_partkey % 5 AS action, p_partkey % 3 AS risk, p_size % 2 = 0 AS http, CASE p_partkey % 4 WHEN 0 THEN 'Product' WHEN 1 THEN 'Cart' WHEN 2 THEN 'SearchResultsPage' END AS own FROM part),
    m AS (SELECT p.*, a.name, a.own AS is_instance, coalesce(a.model, p.own, CASE WHEN a.category = 2 THEN 'Product' ELSE 'Site' END) AS model FROM p JOIN a USING (category, action)),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY domain, model, name ORDER BY p_partkey) = 1),
    c AS (SELECT domain, model, name, is_instance, coalesce(r.method, CASE WHEN category < 2 THEN 'GET' ELSE 'POST' END) AS method, coalesce(r.endpoint, '/' || replace(name, '_', '-')) AS endpoint, coalesce(r.params, '') AS params, risk >= 1 OR category = 3 AS requires_auth,
        CASE WHEN http THEN 'http' ELSE 'browser' END AS path, CASE WHEN http THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM f LEFT JOIN r USING (name))
    SELECT * FROM c
    UNION ALL SELECT DISTINCT domain, 'Site', 'search', false, 'GET', '/search?q={query}', 'query', false, 'http', 0.8::DOUBLE FROM p WHERE own = 'SearchResultsPage' AND domain NOT IN (SELECT domain FROM c WHERE name = 'search')
    UNION ALL SELECT DISTINCT domain, 'Cart', 'view', false, 'GET', '/cart', '', false, 'http', 0.75::DOUBLE FROM p WHERE own = 'Cart'""")
def actions_compiled(spark: SparkSession, d: str) -> DataFrame:
    part, key = table(spark, d, "part"), F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    nodes = part.select(F.col("p_brand").alias("domain"), key.alias("node_id"), pick(key, PAGE_TYPE["product_detail"], PAGE_TYPE["cart"], PAGE_TYPE["search_results"], PAGE_TYPE["forum"]).alias("page_type"))
    found = part.select(F.col("p_brand").alias("domain"), key.alias("node_id"), F.lit(0).alias("place"), pick(F.col("p_size"), 0, 1, 2, 3, 8).alias("category"), (key % 5).cast("int").alias("action"), (key % 3).alias("risk"), (F.col("p_size") % 2 == 0).alias("http"))
    return compiled.compiled(found, nodes).withColumn("params", F.array_join("params.name", ","))


@_query("robots_told", """
    SELECT s_suppkey::VARCHAR AS domain, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 END::DOUBLE AS delay, CASE WHEN s_suppkey % 2 = 0 THEN 'https://s.test/' || s_suppkey || '.xml,https://s.test/b.xml' ELSE '' END AS sitemaps FROM supplier""")
def robots_told(spark: SparkSession, d: str) -> DataFrame:
    key, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    delay = F.when(key % 3 == 0, F.concat(F.lit("Crawl-delay: "), (key % 7).cast("string"), F.lit("\n"))).otherwise("")
    maps = F.when(key % 2 == 0, F.concat(F.lit("Sitemap: https://s.test/"), text, F.lit(".xml\nSitemap: https://s.test/b.xml\n"))).otherwise("")
    files = table(spark, d, "supplier").select(text.alias("domain"), F.concat(F.lit("User-agent: *\nDisallow: /x\n"), delay, maps, F.lit("User-agent: bot\nCrawl-delay: 9\n")).alias("text"))
    return site_files.robots_told(files).select("domain", "delay", F.array_join("sitemaps", ",").alias("sitemaps"))


@_query("stream_fed", "SELECT event_type AS type, 'u' || user_id AS domain, (epoch_us(ts) // 1000)::BIGINT AS at, props AS payload FROM events")
def stream_fed(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON files, read as a feed in several batches."""
    path = graph.shared_path(spark, "feed")
    events = table(spark, d, "events").select(F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("payload"))
    events.repartition(6, "domain").write.json(path)
    out = catalog_queries._drained(spark, feeds.event_feed(spark, path, files_per_trigger=2), "append")
    return out.select("type", "domain", F.unix_millis("ts").alias("at"), "payload")


@_query("stream_deltas", "SELECT c_mktsegment AS domain, '/c/' || c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN 'remove' ELSE 'modify' END AS op, count(*) AS n FROM customer GROUP BY ALL")
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    """A feed of deltas, gathered."""
    path, key = graph.shared_path(spark, "deltas"), F.col("c_custkey")
    table(spark, d, "customer").select(F.col("c_mktsegment").alias("domain"), F.concat(F.lit("/c/"), key.cast("string")).alias("url"), F.when(key % 3 == 0, "remove").otherwise("modify").alias("op")).write.json(path)
    out = catalog_queries._drained(spark, feeds.delta_feed(spark, path, "domain string, url string, op string"), "append")
    return out.groupBy("domain", "url", "op").agg(F.count("*").alias("n"))
