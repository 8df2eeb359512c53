"""Queries of single operators over the given tables, with SQL that states what each must give.

Operators on texts get texts dealt to the rows of a table by key; the SQL names the expected value of each text, so it does
not depend on the operator's own tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import EDGE_TYPE, PAGE_TYPE, models_of
from .catalog_queries import _drained, _event_stream, _log, _order_history, _part_nodes, _points, _query, _trade_graph, dealt, spread, table
from .functions import apps, text, urls
from .operators import delta, graph, observations, schema, timeseries, vector
from .plans.translate import Catalog, wql
from .sources import html_data, results, site_files
from .streaming import feeds


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)


def _dealt(inputs: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in inputs]), (key % len(inputs) + 1).cast("int"))


def _cases(name: str, kind: str, f: Callable[[Column], Column], pairs: list[tuple]) -> None:
    """A column function on texts dealt to all parts by key, and the value of each text."""
    whens = " ".join(f"WHEN {i} THEN {_literal(want)}" for i, (_, want) in enumerate(pairs))

    @_query(name, f"SELECT p_partkey, (CASE p_partkey % {len(pairs)} {whens} END)::{kind} AS result FROM part")
    def run(spark: SparkSession, d: str) -> DataFrame:
        given = table(spark, d, "part").select("p_partkey", _dealt([v for v, _ in pairs], F.col("p_partkey")).alias("given"))
        return given.select("p_partkey", f(F.col("given")).alias("result"))


# --- column functions

_cases("rating_text", "DOUBLE", text.rating_of, [("4.5", 0.9), ("Excellent", 1.0), (" very good ", 0.9), ("85%", 0.85), ("7", 0.7), ("90", 0.9), ("-3", 0.0), ("no rating", 0.0), ("awful", 0.1), ("250", 1.0), ("below average", 0.4)])
_cases("rating_scales", "DOUBLE", lambda c: text.rating_scale(c.cast("double")), [("4", 5.0), ("5", 5.0), ("5.5", 10.0), ("10", 10.0), ("64", 100.0), ("101", 5.0)])
_cases("number_in_text", "DOUBLE", text.number_in, [("1,234.5 stars", 1234.5), ("none", None), ("3", 3.0), ("v1.2.3", None), ("(.5)", 0.5), ("", None)])
_cases("currency_signs", "VARCHAR", text.currency_in, [("$5", "USD"), ("9 € or $10", "EUR"), ("£1", "GBP"), ("¥9", "JPY"), ("5 dollars", None)])
_cases("availability_words", "DOUBLE", text.availability_of, [("In Stock", 1.0), ("https://schema.org/OutOfStock", 0.0), ("currently unavailable", 0.0), ("Pre-Order now", 0.5), ("available", 1.0), ("limited edition", 0.5), ("who knows", None), ("SOLD OUT", 0.0)])
_cases("action_labels", "INT", lambda c: text.action_code(c, F.lit("button"))["category"] * 10 + text.action_code(c, F.lit("button"))["action"], [("Add to Cart", 20), ("remove this from cart", 21), ("Check out", 23), ("Save for later", 25), ("Apply my coupon", 24), ("Search", 10), ("sort by price", 11), ("Sign in", 40), ("Register", 42), ("Log out", 41), ("Play", 50), ("Download PDF", 53), ("share", 60), ("Upvote", 61), ("comment", 62), ("Hello", 1)])
_cases("page_words", "INT", text.page_type_in, [("site pdp dark", 4), ("blog-post", 5), ("serp", 2), ("front-page", 1), ("shopping-cart", 10), ("checkout-flow", 9), ("sign-in", 8), ("my-account", 11), ("plp", 3), ("help-center", 30), ("contact-us", 29), ("about-us", 28), ("api-docs", 6), ("thread-page", 23), ("plans-page", 27), ("tos-page", 20), ("not-found", 12), ("gallery", 14), ("wrapper", None)])
_cases("snake_names", "VARCHAR", text.snake_case, [("ForumPost", "forum_post"), ("Product", "product"), ("FAQ", "f_a_q"), ("already_snake", "already_snake")])
_cases("camel_names", "VARCHAR", text.camel_case, [("has_products", "hasProducts"), ("price", "price"), ("belongs_to_category", "belongsToCategory")])
_cases("plural_names", "VARCHAR", text.plural, [("product", "products"), ("category", "categories"), ("box", "boxes"), ("day", "days"), ("class", "classes"), ("match", "matches")])
_cases("field_aliases", "VARCHAR", text.canonical_field, [("cost", "price"), ("stars", "rating"), ("title", "name"), ("href", "url"), ("maker", "brand"), ("stock", "availability"), ("sku", "sku"), ("kind", "category")])
_cases("hash_fnv1a", "BIGINT", apps.fnv1a, [("", -3750763034362895579), ("a", -5808556873153909620), ("foobar", -8821353812377114648), ("é", 775207407765167617), (None, None)])
_cases("cell_names", "INT", lambda c: apps.cell(c)["row"] * 1000 + apps.cell(c)["col"], [("A1", 0), ("B2", 1001), ("Z10", 9025), ("AA1", 26), ("ab12", 11027), ("1A", None), ("A", None)])
_cases("grid_state", "VARCHAR", lambda c: F.array_join(F.transform(F.array_sort(apps.grid_cells(c)), lambda x: F.concat_ws("=", x["name"], x["value"])), ","), [('{"cells":{"B1":"y","A1":"x"}}', "A1=x,B1=y"), ('{"cells":{}}', "")])
_cases("layer_state", "VARCHAR", lambda c: F.array_join(F.transform(apps.layers(c), lambda x: F.concat_ws(":", x["name"], x["type"], x["visible"].cast("string"))), ","), [('{"layers":[{"name":"bg","type":"rect","visible":true},{"name":"t","type":"text","visible":false}]}', "bg:rect:true,t:text:false"), ('{"layers":[]}', "")])
_cases("canvas_states", "VARCHAR", apps.canvas_kind, [('{"cells":{}}', "spreadsheet"), ('{"rows":1,"columns":2}', "spreadsheet"), ('{"layers":[]}', "design"), ('{"lat":1,"lng":2}', "map"), ('{"board":1,"shapes":[]}', "whiteboard"), ("{}", "unknown")])
_cases("canvas_pages", "BOOLEAN", apps.canvas_app, [("<canvas id=x>", True), ("c.getContext('2d')", True), ("<p>canvas</p>", False)])
_cases("tool_pages", "BOOLEAN", apps.offers_tools, [("navigator.modelContext.provide()", True), ('<meta name="model-context">', True), ("if (navigator.ai)", True), ("<p>model</p>", False)])
_cases("tool_categories", "BOOLEAN", lambda c: apps.fits_category(c, F.lit(""), F.lit(2)), [("addToCart", True), ("go to CHECKOUT", True), ("search the site", False), ("wishlist", True)])
_cases("rest_addresses", "VARCHAR", apps.known_address, [("https://en.wikipedia.org/wiki/Rust", "https://en.wikipedia.org/api/rest_v1/page/summary/Rust"), ("https://github.com/a/b/issues", "https://api.github.com/repos/a/b"), ("https://www.reddit.com/r/x", "https://www.reddit.com/r/x.json"), ("https://pypi.org/project/numpy/", "https://pypi.org/pypi/numpy/json"), ("https://crates.io/crates/serde", "https://crates.io/api/v1/crates/serde"), ("https://www.npmjs.com/package/left", "https://registry.npmjs.org/left"), ("https://shop.com/x", None)])
_cases("known_socket_sites", "BOOLEAN", apps.known_sockets, [("app.slack.com", True), ("discord.com", True), ("yahoo.com", True), ("shop.test", False)])
_cases("known_drag_sites", "BOOLEAN", apps.known_drag, [("trello.com", True), ("my.monday.com", True), ("atlassian.com", True), ("trello.com.evil.test", False), ("shop.test", False)])
_cases("known_rest_sites", "BOOLEAN", apps.known_rest, [("github.com", True), ("npmjs.com", True), ("gist.github.com", False)])
_cases("third_party_hosts", "BOOLEAN", apps.third_party, [("https://www.google-analytics.com/a.js", True), ("https://js.SENTRY.io/x", True), ("https://shop.com/a.js", False)])
_cases("nearest_names", "VARCHAR", lambda c: apps.nearest_name(c, ["map", "query", "pathfind"]), [("qury", "query"), ("mpa", "map"), ("zzzzzzzz", None), ("pathfnd", "pathfind")])
_cases("same_sites", "BOOLEAN", lambda c: urls.same_site(c, F.lit("https://shop.com/a")), [("http://www.shop.com/b", True), ("https://shop.com:8080/", True), ("https://blog.shop.com/", False), ("https://SHOP.com", True)])
_cases("same_origins", "BOOLEAN", lambda c: urls.same_origin(c, F.lit("https://shop.com/a")), [("https://SHOP.com/b", True), ("http://shop.com/a", False), ("https://shop.com:8080/", False), ("https://www.shop.com/", False)])
_cases("typed_domains", "VARCHAR", urls.normal_domain, [("https://www.Shop.com/a?b", "shop.com"), (" shop.com:80 ", "shop.com"), ("WWW.a.org", "a.org"), ("http://x.test#y", "x.test")])
_cases("resolved_urls", "VARCHAR", lambda c: urls.resolve(F.lit("https://a.com/x/y?z=1"), c), [("c", "https://a.com/x/c"), ("/c", "https://a.com/c"), ("../c", "https://a.com/c"), ("//b.org/d", "https://b.org/d"), ("?q", "https://a.com/x/y?q"), ("#f", "https://a.com/x/y?z=1#f"), (None, None)])
_cases("moments", "VARCHAR", lambda c: F.date_format(timeseries.moment(c), "yyyy-MM-dd HH:mm:ss"), [("2024-05-06", "2024-05-06 00:00:00"), ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"), ("2024-05-06T07:08:09+02:00", "2024-05-06 05:08:09"), ("2024-05-06t07:08:09.5z", "2024-05-06 07:08:09"), ("yesterday", None), ("2024-13-01", None)])
_cases("classified_paths", "INT", lambda c: urls.classify(c)["page_type"], [("https://x.com/", 1), ("https://x.com/dp/B0", 4), ("https://x.com/blog/post", 5), ("https://x.com/about", 28), ("https://x.com/contact", 29), ("https://x.com/cart", 10), ("https://x.com/checkout", 9), ("https://x.com/login", 8), ("https://x.com/xyz", 0), ("https://x.com/search?q=a", 2), ("https://x.com/category/a", 3), ("https://x.com/docs/a", 6), ("https://x.com/faq", 30), ("https://x.com/pricing", 27), ("https://x.com/privacy", 20), ("https://x.com/a.pdf", 21), ("https://x.com/a.png", 14), ("https://x.com/forum", 23), ("https://x.com/sitemap", 31), ("https://x.com/account", 11)])
_cases("pii_kinds", "VARCHAR", lambda c: F.array_join(F.transform(text.pii_matches(c), lambda m: m["type"]), ","), [("mail a.b+c@d-e.org", "email"), ("ssn 123-45-6789.", "ssn"), ("card 4111-1111-1111-1111", "credit_card"), ("call (555) 123-4567", "phone"), ("plain text, 12345", ""), ("a@b.co and c@d.eu", "email,email")])
_cases("threat_kinds", "VARCHAR", lambda c: F.array_join(text.threats(c), ","), [("<script>alert(1)</script>", "script_injection"), ("../../etc/passwd", "path_traversal"), ("John Doe", ""), ("1; DROP users", "sql_injection"), ("select x from y", "sql_injection"), ("<a onclick = 'x'>", "event_handler"), ("a -- b", "sql_injection"), ("<SCRIPT src=..\\x>", "script_injection,path_traversal")])
_cases("cleaned_texts", "VARCHAR", text.sanitized, [("<script>x", "x"), ("a onload=b", "a b"), ("../x..\\y", "xy"), ("plain", "plain")])
_cases("shown_counts", "VARCHAR", lambda c: schema.shown(53, F.log1p(c.cast("double")) / 10), [("0", "0"), ("1", "1"), ("128", "128"), ("4000", "4000")])
_cases("shown_values", "VARCHAR", lambda c: F.concat_ws(" ", schema.shown(48, c.cast("double")), schema.shown(50, c.cast("double")), schema.shown(52, c.cast("double")), schema.shown(51, c.cast("double"))), [("0.25", "0.25 25% 0.3 out_of_stock"), ("1.0", "1.00 100% 1.0 in_stock"), ("0.75", "0.75 75% 0.8 in_stock")])

_cases("types_in_python", "VARCHAR", lambda c: schema.type_in("python", c), [("float", "float"), ("integer", "int"), ("url", "str"), ("datetime", "datetime"), ("enum(a,b)", 'Literal["a", "b"]')])
_cases("types_in_typescript", "VARCHAR", lambda c: schema.type_in("typescript", c), [("float", "number"), ("bool", "boolean"), ("datetime", "string"), ("enum(a, b)", '"a" | "b"')])
_cases("types_in_openapi", "VARCHAR", lambda c: schema.type_in("openapi", c), [("float", "number"), ("integer", "integer"), ("bool", "boolean"), ("enum(a,b)", "string"), ("odd", "string")])
_cases("types_in_graphql", "VARCHAR", lambda c: schema.type_in("graphql", c), [("float", "Float"), ("integer", "Int"), ("bool", "Boolean"), ("url", "String")])


# --- the query language: what the first queries leave out


def _shop(spark: SparkSession, d: str) -> Catalog:
    """Parts as typed nodes, read through the models' fields; a part's history is a price per order of it."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.col("p_brand").alias("domain"), F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("url"), F.lit("price").alias("field")]
    prices = lambda: lines.groupBy(*keys, F.col("l_shipdate").alias("ts")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    return Catalog(models_of(_part_nodes(spark, d)), prices, dt.datetime(1998, 1, 1))


_NODES = "(SELECT p_brand AS domain, '/part/' || p_partkey AS url, p_partkey::INT AS node_id, p_retailprice::FLOAT::DOUBLE AS price, nullif(((p_partkey % 50) / 50.0::DOUBLE)::FLOAT::DOUBLE, 0) AS rating, nullif((p_size / 50.0::DOUBLE)::FLOAT::DOUBLE, 0) AS seller_reputation, p_partkey % 7 = 0 AS article FROM part)"
_PRICES = "(SELECT p_brand AS domain, '/part/' || l_partkey AS url, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
for _name, _text, _oracle in (
    ("wql_in", "SELECT price FROM Product WHERE rating IN (0.5, 0.62) AND price NOT IN (905)", f"SELECT domain, url, node_id, price FROM {_NODES} WHERE NOT article AND (abs(rating - 0.5) < 0.001 OR abs(rating - 0.62) < 0.001) AND NOT abs(price - 905) < 0.001"),
    ("wql_between", "SELECT price FROM Product WHERE price BETWEEN 905 AND 915 AND rating NOT BETWEEN 0.2 AND 0.8", f"SELECT domain, url, node_id, price FROM {_NODES} WHERE NOT article AND price BETWEEN 905 AND 915 AND rating NOT BETWEEN 0.2 AND 0.8"),
    ("wql_like", "SELECT price FROM Product WHERE url LIKE '/part/1_' OR url LIKE '%77'", f"SELECT domain, url, node_id, price FROM {_NODES} WHERE NOT article AND (url LIKE '/part/1_' OR url LIKE '%77')"),
    ("wql_is_null", "SELECT price FROM Product WHERE rating IS NULL", f"SELECT domain, url, node_id, price FROM {_NODES} WHERE NOT article AND rating IS NULL"),
    ("wql_is_not_null", "SELECT rating FROM Article WHERE rating IS NOT NULL ORDER BY rating DESC LIMIT 20", f"SELECT domain, url, node_id, rating FROM {_NODES} WHERE article AND rating IS NOT NULL ORDER BY rating DESC, domain, node_id LIMIT 20"),
    ("wql_typed_models", "SELECT price, rating, seller_reputation FROM Product WHERE price > 904 AND seller_reputation >= 0.5 ACROSS 'Brand#11', 'Brand#12'", f"SELECT domain, url, node_id, price, rating, seller_reputation FROM {_NODES} WHERE NOT article AND price > 904 AND seller_reputation >= 0.5 AND domain IN ('Brand#11', 'Brand#12')"),
    ("wql_best_domain", "SELECT best_historic_price_domain FROM Product LIMIT 5", f"SELECT domain, url, node_id, (SELECT arg_min(domain, (value, domain)) FROM {_PRICES}) AS best_historic_price_domain FROM {_NODES} WHERE NOT article ORDER BY domain, node_id LIMIT 5"),
):
    _query(_name, _oracle)(lambda spark, d, q=_text: wql(spark, q, _shop(spark, d)))

_LINE = f"""WITH x AS (SELECT domain, url, ts, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY domain, url))::DOUBLE / 86400000000 AS x, value AS y FROM {_PRICES}),
f AS (SELECT domain, url, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, max(x) AS last_x, arg_max(y, x) AS last_y FROM x GROUP BY ALL)
"""


@_query("wql_predicted", _LINE + f"SELECT p.domain, p.url, node_id, round(CASE WHEN n < 3 THEN NULL WHEN vx * n * n < 1e-10 THEN last_y ELSE intercept + slope * (last_x + 30) END, 4) AS predicted FROM {_NODES} p LEFT JOIN f ON p.domain = f.domain AND p.url = f.url WHERE NOT article")
def wql_predicted(spark: SparkSession, d: str) -> DataFrame:
    out = wql(spark, "SELECT predicted_price_30d AS predicted FROM Product", _shop(spark, d))
    return out.withColumn("predicted", F.round("predicted", 4))


@_query("wql_trend", _LINE + f"""SELECT p.domain, p.url, node_id, CASE WHEN n >= 3 AND vx * n * n >= 1e-10 AND CASE WHEN vy = 0 THEN 0 ELSE r2 END >= 0.3 THEN
CASE WHEN abs(slope) < 0.01 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END END AS price_trend FROM {_NODES} p LEFT JOIN f ON p.domain = f.domain AND p.url = f.url WHERE NOT article""")
def wql_trend(spark: SparkSession, d: str) -> DataFrame:
    return wql(spark, "SELECT price_trend FROM Product", _shop(spark, d))


# --- graphs


@_query("filter_expression", f"SELECT node_id FROM {_NODES} WHERE price <= 905::FLOAT AND rating >= 0.5::FLOAT")
def filter_expression(spark: SparkSession, d: str) -> DataFrame:
    return graph.filter_nodes(_part_nodes(spark, d), ranges=[graph.parse_filter("48<905"), graph.parse_filter("52>0.5")]).select("node_id")


@_query("site_graph_node", "SELECT p_partkey::INT AS node_id, '/part/' || p_partkey AS url FROM part WHERE p_partkey = 42")
def site_graph_node(spark: SparkSession, d: str) -> DataFrame:
    nodes, (_, edges) = _part_nodes(spark, d), _trade_graph(spark, d)
    return graph.SiteGraph(nodes, edges).node(42).select("node_id", "url")


@_query("site_graph_edges", "SELECT o_orderkey * 4 AS src, o_custkey * 4 + 1 AS dst FROM orders WHERE o_orderkey = 7 UNION ALL SELECT DISTINCT l_orderkey * 4, l_partkey * 4 + 2 FROM lineitem WHERE l_orderkey = 7")
def site_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_from(_trade_graph(spark, d)[1], 28).select("src", "dst")


@_query("nodes_updated", "SELECT p_partkey::INT AS node_id, CASE WHEN p_partkey % 10 = 0 THEN 7 ELSE (p_partkey % 256)::INT END AS confidence FROM part UNION ALL SELECT (p_partkey + 10000000)::INT, 7 FROM part WHERE p_partkey % 100 = 0")
def nodes_updated(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    tens = nodes.where("node_id % 10 = 0").select("domain", "node_id", F.lit(7).alias("confidence"))
    new = nodes.where("node_id % 100 = 0").select("domain", (F.col("node_id") + 10_000_000).alias("node_id"), F.lit(7).alias("confidence"))
    return graph.updated(nodes, tens.unionByName(new)).select("node_id", "confidence")


@_query("nodes_flagged", "SELECT p_partkey::INT AS node_id, ((p_partkey % 128) | CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 0 END)::INT AS flags FROM part")
def nodes_flagged(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    more = nodes.where("node_id % 3 = 0").select("domain", "node_id", F.explode(F.array(F.lit(4), F.lit(8))).alias("flags"))
    return graph.with_flags(nodes, more).select("node_id", "flags")


@_query("nodes_built", """
WITH e AS (SELECT DISTINCT p_brand AS domain, l_partkey AS src, (l_partkey + 1) AS dst FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_partkey::INT AS node_id, (SELECT count(*) FROM e WHERE dst = p_partkey AND domain = p_brand)::INT AS inbound_count, (SELECT count(*) FROM e WHERE src = p_partkey AND domain = p_brand)::INT AS outbound_count,
round(sqrt((p_retailprice::FLOAT::DOUBLE)^2 + (((p_partkey % 50) / 50.0::DOUBLE)::FLOAT::DOUBLE)^2 + ((p_size / 50.0::DOUBLE)::FLOAT::DOUBLE)^2), 1) AS feature_norm FROM part""")
def nodes_built(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("node_id"))
    edges = lines.join(nodes.select("domain", "node_id"), "node_id").select("domain", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst")).distinct()
    built = graph.built(nodes, edges)
    return built.select("node_id", F.col("inbound_count").cast("int").alias("inbound_count"), F.col("outbound_count").cast("int").alias("outbound_count"), F.round(F.col("feature_norm").cast("double"), 1).alias("feature_norm"))


@_query("linked_pages", """
WITH n AS (SELECT p_brand AS domain, p_partkey AS node_id FROM part),
m AS (SELECT DISTINCT a.domain, a.node_id AS src, b.node_id AS dst FROM n a JOIN n b ON a.domain = b.domain AND b.node_id IN (a.node_id + 1, a.node_id * 2) AND a.node_id <> b.node_id)
SELECT src::INT AS src, dst::INT AS dst, 1 AS weight FROM m UNION ALL SELECT dst::INT, src::INT, 2 FROM m""")
def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    n = F.col("node_id")
    links = nodes.select("domain", n.alias("src"), F.explode(F.array(n, n + 1, n * 2, n + 1)).alias("to")).select("domain", "src", F.concat(F.lit("/part/"), F.col("to").cast("string")).alias("url"))
    return graph.link_edges(dealt(links, "domain", "url"), nodes).select("src", "dst", "weight")


@_query("breadcrumbs", "SELECT DISTINCT p AS src, l_partkey::INT AS dst FROM (SELECT l_partkey, lag(l_partkey::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem) WHERE p IS NOT NULL AND p <> l_partkey")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    crumbs = table(spark, d, "lineitem").select(F.lit("s").alias("domain"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("int").alias("node_id"))
    return graph.crumb_edges(crumbs).select("src", "dst")


@_query("cluster_page_types", """
WITH c AS (SELECT p_size AS cluster, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 4 END AS page_type, count(*) AS n FROM part GROUP BY ALL)
SELECT cluster, arg_max(page_type, (n, -page_type))::INT AS page_type FROM c GROUP BY cluster""")
def cluster_page_types(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("node_id"), F.col("p_size").alias("cluster"))
    return graph.cluster_types(_part_nodes(spark, d), clusters)


@_query("render_next", """
WITH n AS (SELECT p_brand AS domain, p_partkey AS id, p_partkey % 13 AS inbound, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 4 END AS t, (p_partkey % 128) & 1 AS rendered FROM part),
s AS (SELECT *, sum(rendered) OVER (PARTITION BY domain, t) AS seen FROM n)
SELECT id::INT AS node_id, round(2 * inbound + 10.0::DOUBLE + CASE WHEN seen < 2 THEN 5 ELSE 0 END, 6)::DOUBLE AS priority FROM s WHERE rendered = 0 ORDER BY priority DESC, domain, id LIMIT 40""")
def render_next(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d).withColumn("inbound_count", F.col("node_id") % 13)
    return graph.render_order(nodes, 40).select("node_id", F.round("priority", 6).alias("priority"))


@_query("refresh_stale", "SELECT p_partkey::INT AS node_id FROM part WHERE (p_partkey % 200) / 255.0::DOUBLE < 0.25")
def refresh_stale(spark: SparkSession, d: str) -> DataFrame:
    return graph.refresh_set(_part_nodes(spark, d).withColumn("freshness", F.col("node_id") % 200), below=0.25).select("node_id")


@_query("refresh_cluster", "SELECT p_partkey::INT AS node_id FROM part WHERE p_size = 3")
def refresh_cluster(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("node_id"), F.col("p_size").alias("cluster"))
    return graph.refresh_set(_part_nodes(spark, d), clusters=(clusters, 3), below=0.1).select("node_id")


@_query("diverse_by_path", """
SELECT page_id FROM (SELECT page_id, p, row_number() OVER (PARTITION BY p ORDER BY page_id) AS k FROM (SELECT page_id, '/' || split_part(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/', 2) AS p FROM pages)) ORDER BY k, p, page_id LIMIT 30""")
def diverse_by_path(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").alias("node_id"), urls.prefix(F.col("url")).alias("prefix"))
    return graph.diverse_sample(pages, 30, "prefix").select("page_id")




def _part_links(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("int")
    pairs = table(spark, d, "part").select(n.alias("src"), F.explode(F.array(n + 1, n + 40, n * 3)).alias("dst"))
    last = table(spark, d, "part").agg(F.max("p_partkey").cast("int").alias("last"))
    met = pairs.join(F.broadcast(last), F.col("dst") <= F.col("last")).drop("last")  # one row
    flags = F.when((F.col("src") + F.col("dst")) % 4 == 0, 4).otherwise(0) + F.when((F.col("src").cast("long") * F.col("dst")) % 11 == 0, 1).otherwise(0)
    return met.select("src", "dst", F.lit(1).alias("weight"), flags.alias("flags"))


@_query("shortest_state_changes")
def shortest_state_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fewest state changes from the first part over all links between parts, without those that need a login."""
    return graph.shortest_paths(_part_links(spark, d), 1, mode="state_changes", avoid=("requires_auth",)).select("node", "cost")


# --- time series


@_query("history_of_node", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, arg_max(o_totalprice, o_orderkey) AS value FROM orders WHERE o_custkey = 7 AND o_orderdate > TIMESTAMP '1993-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY o_orderdate")
def history_of_node(spark: SparkSession, d: str) -> DataFrame:
    out = timeseries.history(_order_history(spark, d), url="/customer/7", field="total", since=dt.datetime(1993, 1, 1), until=dt.datetime(1997, 1, 1))
    return out.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


@_query("histories_compared", "SELECT '/customer/' || o_custkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS day, arg_max(o_totalprice, o_orderkey) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_custkey, c_mktsegment) IN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (1, 4, 10)) AND o_orderdate > TIMESTAMP '1995-01-01' GROUP BY o_custkey, o_orderdate")
def histories_compared(spark: SparkSession, d: str) -> DataFrame:
    nodes = [(r.c_mktsegment, f"/customer/{r.c_custkey}") for r in table(spark, d, "customer").where(F.col("c_custkey").isin(1, 4, 10)).collect()]
    out = timeseries.compare_history(_order_history(spark, d), nodes, "total", dt.datetime(1995, 1, 1))
    return out.select("url", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


_RULES = "(VALUES ('r1', 'click', 'value_above', 50.0), ('r2', 'view', 'value_below', 20.0), ('r3', 'purchase', 'change_by_percent', 0.5), ('r4', 'search', 'new_instance', 0.0), ('r6', 'login', 'available', 0.0)) r(id, event_type, condition, threshold)"
_RAISED = f"""(SELECT id, event_id, ts, before, value FROM (SELECT event_id, ts, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) JOIN {_RULES} USING (event_type)
WHERE coalesce(CASE condition WHEN 'value_above' THEN value > threshold AND before <= threshold WHEN 'value_below' THEN value < threshold AND before >= threshold WHEN 'change_by_percent' THEN before <> 0 AND abs((value - before) / nullif(before, 0)) > threshold
WHEN 'available' THEN before <= 0 AND value > 0 WHEN 'new_instance' THEN before IS NULL END, false))"""


def _rules(spark: SparkSession) -> DataFrame:
    """Rules added one after another; r1 is replaced, r5 inactive, r7 taken back."""
    rule = lambda i, domain, condition, threshold, active=True: spark.range(1).select(F.lit(i).alias("id"), F.lit(domain).alias("domain"), F.lit("value").alias("field"), F.lit(condition).alias("condition"), F.lit(threshold).cast("double").alias("threshold"), F.lit(active).alias("active"))
    rules = rule("r1", "click", "value_above", 1.0)
    for more in (("r1", "click", "value_above", 50.0), ("r2", "view", "value_below", 20.0), ("r3", "purchase", "change_by_percent", 0.5), ("r4", "search", "new_instance", 0.0), ("r5", "click", "value_above", 1.0, False), ("r6", "login", "available", 0.0), ("r7", "view", "value_above", 0.0)):
        rules = timeseries.with_rule(rules, rule(*more))
    return timeseries.without_rule(rules, "r7")


def _watched(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d).select(F.col("event_type").alias("domain"), F.col("user").cast("string").alias("url"), F.lit("value").alias("field"), "ts", "event_id", "value")
    return timeseries.alerts(points, _rules(spark), ("event_id",))


@_query("watch_alerts", f"SELECT id, event_id, before, value FROM {_RAISED}")
def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _watched(spark, d).select("id", "event_id", "before", "value")


@_query("alerts_recent", f"SELECT id, event_id FROM {_RAISED} ORDER BY ts DESC, event_id DESC LIMIT 25")
def alerts_recent(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.recent(_watched(spark, d).withColumn("at", F.struct("ts", "event_id")), 25, "at").select("id", "event_id")


@_query("rules_triggered", f"SELECT n.id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_triggered, count(ts) AS alerts FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6')) n(id) LEFT JOIN {_RAISED} r ON n.id = r.id GROUP BY n.id")
def rules_triggered(spark: SparkSession, d: str) -> DataFrame:
    out = timeseries.last_triggered(_rules(spark), _watched(spark, d))
    return out.select("id", F.date_format("last_triggered", "yyyy-MM-dd HH:mm:ss").alias("last_triggered"), "alerts")


# --- snapshots, registry, caches


def _registry(spark: SparkSession, d: str) -> delta.Registry:
    """A registry in the shared folder: parts as first snapshots, order lines as dated deltas, one site pushed again."""
    held = delta.Registry(spark, graph.shared_path(spark, "registry"))
    nodes = _part_nodes(spark, d).select("domain", "url", "node_id", "flags")
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("domain")), F.col("l_partkey") == F.col("p_partkey"))
    held.push(nodes, lines.select("domain", F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("instance"), F.col("l_linenumber").alias("line")))
    held.push(nodes.where("domain = 'Brand#11' and node_id % 2 = 0").withColumn("flags", F.lit(99)))
    return held


@_query("registry_pull", "SELECT p_brand AS domain, p_partkey::INT AS node_id, CASE WHEN p_brand = 'Brand#11' THEN 99 ELSE (p_partkey % 128)::INT END AS flags FROM part WHERE p_brand <> 'Brand#11' OR p_partkey % 2 = 0")
def registry_pull(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).pull().select("domain", "node_id", "flags")


@_query("registry_since", "SELECT l_orderkey AS instance, l_linenumber AS line, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND l_shipdate > TIMESTAMP '1996-06-01'")
def registry_since(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).deltas_since("Brand#12", dt.datetime(1996, 6, 1)).select("instance", "line", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@_query("registry_stats", "SELECT p_brand AS domain, CASE WHEN p_brand = 'Brand#11' THEN count(*) FILTER (p_partkey % 2 = 0) ELSE count(*) END AS nodes, true AS sized, (SELECT count(*) FROM lineitem JOIN part q ON l_partkey = q.p_partkey WHERE q.p_brand = p.p_brand) AS deltas FROM part p GROUP BY p_brand")
def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).stats().select("domain", "nodes", (F.col("bytes") > 0).alias("sized"), "deltas")


@_query("cache_unexpired", "SELECT o_orderkey FROM orders WHERE epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) <= 86400 * 365")
def cache_unexpired(spark: SparkSession, d: str) -> DataFrame:
    return delta.unexpired(table(spark, d, "orders"), dt.datetime(1998, 1, 1), 86_400 * 365, "o_orderdate").select("o_orderkey")


@_query("cache_evicted", "SELECT domain FROM (SELECT 'c' || o_custkey AS domain, row_number() OVER (ORDER BY max(o_orderdate) DESC, 'c' || o_custkey) AS k FROM orders GROUP BY o_custkey) WHERE k > 500")
def cache_evicted(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain")).agg(F.max("o_orderdate").alias("used_at"))
    return delta.least_recent(used, 500).select("domain")


@_query("maintenance_counts", """
WITH c AS (SELECT o_custkey, count(*) AS a, count(*) FILTER (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) <= 86400 * 1000) AS f FROM orders GROUP BY o_custkey)
SELECT sum(a)::BIGINT AS entries, sum(a - f)::BIGINT AS expired, sum(f - least(f, 3))::BIGINT AS collected, sum(least(f, 3))::BIGINT AS "left" FROM c""")
def maintenance_counts(spark: SparkSession, d: str) -> DataFrame:
    return delta.maintained(table(spark, d, "orders"), ["o_custkey"], 3, dt.datetime(1998, 1, 1), 86_400 * 1000, "o_orderdate")


@_query("watched_dims", "SELECT p_partkey::INT AS node_id, 48 AS dim, round(p_retailprice::FLOAT::DOUBLE, 2) AS old, round((p_retailprice::FLOAT + 5)::FLOAT::DOUBLE, 2) AS new FROM part WHERE p_partkey % 3 = 0")
def watched_dims(spark: SparkSession, d: str) -> DataFrame:
    moved = F.transform("features", lambda v, i: F.when(i.isin(48, 49) & (F.col("node_id") % 3 == 0), v + F.lit(5).cast("float")).otherwise(v))
    pairs = _part_nodes(spark, d).select("node_id", F.col("features").alias("old"), moved.alias("new"))
    out = delta.changed_dims(pairs, [48, 52], 0.5).select("node_id", F.explode("changes").alias("c"))
    return out.select("node_id", "c.dim", F.round(F.col("c.old").cast("double"), 2).alias("old"), F.round(F.col("c.new").cast("double"), 2).alias("new"))


@_query("feature_hashes", "SELECT count(DISTINCT (p_retailprice::FLOAT, ((p_partkey % 50) / 50.0::DOUBLE)::FLOAT, p_size)) AS distinct_features FROM part")
def feature_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _part_nodes(spark, d).agg(F.countDistinct(delta.feature_hash(F.col("features"))).alias("distinct_features"))


@_query("privacy_dims", "SELECT p_partkey::INT AS node_id, unnest([48, 87, 88, 89, 90, 111, 112, 127]) AS dim, unnest(CASE WHEN (p_partkey % 128) & 16 <> 0 THEN [0, 0, 0, 0, 0, 0, 0, 0] ELSE [49, 88, 0, 0, 91, 112, 0, 0] END)::INT AS value FROM part")
def privacy_dims(spark: SparkSession, d: str) -> DataFrame:
    full = _part_nodes(spark, d).withColumn("features", F.transform("features", lambda v, i: (i + 1).cast("float")))
    dims = F.array(*[F.lit(i) for i in (48, 87, 88, 89, 90, 111, 112, 127)])
    out = delta.stripped(full).select("node_id", "features", F.explode(dims).alias("dim"))
    return out.select("node_id", "dim", F.get("features", F.col("dim")).cast("int").alias("value"))


# --- schemas


@_query("model_totals", """
WITH t AS (SELECT p_brand AS domain, CASE WHEN p_partkey % 7 = 0 THEN 'Article' ELSE 'Product' END AS model, p_partkey, p_size FROM part WHERE (p_partkey % 256) / 255.0::DOUBLE >= 0.3),
m AS (SELECT domain, model, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT DISTINCT domain, model, 'price' AS f FROM t WHERE model = 'Product' UNION SELECT domain, model, 'rating' FROM t WHERE p_partkey % 50 <> 0 UNION SELECT domain, model, 'seller_reputation' FROM t WHERE model = 'Product' AND p_size <> 0 UNION SELECT domain, model, 'url' FROM t UNION SELECT domain, model, 'node_id' FROM t)
SELECT count(*) AS models, sum(n)::BIGINT AS instances, (SELECT count(*) FROM f JOIN m USING (domain, model)) AS fields FROM m""")
def model_totals(spark: SparkSession, d: str) -> DataFrame:
    return schema.totals(_part_nodes(spark, d)).select("models", "instances", "fields")


@_query("field_examples", """
WITH t AS (SELECT p_brand AS domain, format('{:.2f}', p_retailprice::FLOAT::DOUBLE) AS e FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 256) / 255.0::DOUBLE >= 0.3),
k AS (SELECT domain, e, row_number() OVER (PARTITION BY domain ORDER BY e) AS k FROM (SELECT DISTINCT domain, e FROM t))
SELECT domain, string_agg(e, ',' ORDER BY e) AS examples FROM k WHERE k <= 5 AND domain IN (SELECT domain FROM t GROUP BY domain HAVING count(*) >= 2) GROUP BY domain""")
def field_examples(spark: SparkSession, d: str) -> DataFrame:
    return schema.fields(_part_nodes(spark, d)).where("field = 'price'").select("domain", F.array_join("examples", ",").alias("examples"))


@_query("models_by_instances", "SELECT p_type AS type, count(*) AS total_instances, row_number() OVER (ORDER BY count(*) DESC, p_type)::INT AS rank FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 4")
def models_by_instances(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").groupBy(F.col("p_brand").alias("domain"), F.col("p_type").alias("type"), F.col("p_type").alias("model")).agg(F.count("*").alias("instances"))
    return schema.top_models(schema.unified_models(found), 4).select("type", "total_instances", "rank")


@_query("fields_by_site", """
WITH f AS (SELECT DISTINCT p_brand AS domain, p_type AS type, CASE p_size % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'name' WHEN 2 THEN 'price' ELSE 'sku' END AS field FROM part)
SELECT n.type, n.field, s.domain, EXISTS (SELECT 1 FROM f WHERE f.type = n.type AND f.field = n.field AND f.domain = s.domain) AS present FROM (SELECT DISTINCT type, field FROM f) n JOIN (SELECT DISTINCT type, domain FROM f) s ON n.type = s.type""")
def fields_by_site(spark: SparkSession, d: str) -> DataFrame:
    names = F.get(F.array(F.lit("price"), F.lit("title"), F.lit("cost"), F.lit("sku")), F.col("p_size") % 4)
    return schema.field_sources(table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("type"), names.alias("field")))


@_query("site_actions", "SELECT p_type AS model, (p_size % 3)::INT AS category, (p_size % 5)::INT AS action, count(DISTINCT p_partkey) AS nodes, max(p_size % 2)::INT AS risk FROM part GROUP BY ALL")
def site_actions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_type").alias("model"), (F.col("p_size") % 3).alias("category"), (F.col("p_size") % 5).alias("action"), F.col("p_partkey").alias("node_id"), (F.col("p_size") % 2).alias("risk"))
    return schema.actions(p)


# --- vectors and observations


@_query("features_merged", """
SELECT p_partkey::INT AS node_id, CASE WHEN p_size % 2 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 7 ELSE 0 END::INT AS one_side, CASE WHEN p_partkey % 3 < 2 THEN 9 ELSE 4 END::INT AS both, 5 AS rest FROM part""")
def features_merged(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    zero, size = F.lit(0.0), F.col("p_size")
    seen = F.array(F.when(size % 2 == 0, 3.0).otherwise(zero), F.lit(4.0), zero)
    static = F.array(F.when((size % 2 != 0) & (size % 3 == 0), 7.0).otherwise(zero), F.lit(9.0), F.lit(5.0))
    merged = vector.merged_features(seen, static, (F.col("p_partkey") % 3).cast("double"), F.lit(1.0))
    out = p.select(F.col("p_partkey").cast("int").alias("node_id"), merged.alias("f"))
    return out.select("node_id", *[F.get("f", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("one_side", "both", "rest"))])


@_query("images_compared", "SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.75 END)::DOUBLE AS similarity, (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '0,0,40,40' END) AS regions FROM part")
def images_compared(spark: SparkSession, d: str) -> DataFrame:
    """Grey images of 80 x 80: alike, or with the upper left quarter changed."""
    rows = lambda value: F.array_repeat(F.array_repeat(F.lit(value), 80), 80)
    quarter = F.transform(rows(10), lambda row, y: F.transform(row, lambda v, x: F.when((y < 40) & (x < 40), 200).otherwise(v)))
    pairs = spread(table(spark, d, "part").select("p_partkey")).select(F.col("p_partkey").alias("key"), rows(10).alias("a"), F.when(F.col("p_partkey") % 2 == 0, rows(20)).otherwise(quarter).alias("b"))
    shown = F.array_join(F.transform("regions", lambda r: F.concat_ws(",", r["x"].cast("string"), r["y"].cast("string"), r["width"].cast("string"), r["height"].cast("string"))), ";")
    return vector.image_diffs(pairs).select(F.col("key").alias("p_partkey"), "similarity", shown.alias("regions"))


@_query("observation_linked", "SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id * 100 + turn = 201 THEN 77 ELSE conv_id END AS memory_link FROM conversations")
def observation_linked(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("memory_link", F.col("session_id").cast("long"))
    return observations.linked(log, 201, 77).select("id", F.col("memory_link").cast("long").alias("memory_link"))


@_query("observation_session", "SELECT conv_id * 100 + turn AS id FROM conversations WHERE conv_id = 3")
def observation_session(spark: SparkSession, d: str) -> DataFrame:
    return observations.by_session(_log(spark, d), 3).select("id")


@_query("observation_range", "SELECT conv_id * 100 + turn AS id FROM conversations WHERE conv_id * 60 + turn BETWEEN 120 AND 600")
def observation_range(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s: F.timestamp_seconds(F.lit(s))
    log = _log(spark, d)
    return observations.in_range(log, at(120), at(600)).select("id")


# --- sources


def _files(spark: SparkSession, d: str, said: str, *values: Column) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("domain"), F.format_string(said, *values).alias("text"))


@_query("robots_rules", "SELECT 's' || page_id AS domain, unnest(['disallow', 'allow', 'disallow']) AS kind, unnest(['/private/' || page_id, '/private/open', '/*.pdf$']) AS pattern FROM pages")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    said = "User-agent: other\nDisallow: /\n\nUser-agent: *  # all\nDisallow: /private/%d\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nCrawl-delay: 2\nSitemap: https://x/s.xml\n"
    return site_files.robots_rules(_files(spark, d, said, F.col("page_id")))


@_query("robots_allowed", "SELECT page_id, NOT starts_with(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '/en/') OR contains(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '/en/1') AS allowed FROM pages")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Rules of every site: /en/ is closed but for what begins with /en/1."""
    pages = table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("domain"))
    rule = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"))
    rules = pages.select("domain").distinct().select("domain", F.inline(F.array(rule("disallow", "/en/*"), rule("allow", "/en/1"), rule("disallow", ""), rule("allow", "/e"))))
    return urls.robots_allowed(pages, rules).select("page_id", "allowed")


@_query("sitemaps", "SELECT 's' || page_id AS domain, unnest(['https://a/' || page_id, 'https://b/']) AS url, unnest(['2024-03-01', NULL]) AS day, unnest([0.9, 0.5])::DOUBLE AS priority FROM pages")
def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    said = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/%d</loc><lastmod>2024-03-01</lastmod><priority>0.9</priority></url><url><loc> https://b/ </loc></url><url><lastmod>2020-01-01</lastmod></url></urlset>'
    out = site_files.sitemap_entries(_files(spark, d, said, F.col("page_id")))
    return out.select("domain", "url", F.date_format("lastmod", "yyyy-MM-dd").alias("day"), "priority")


@_query("feeds_read", "SELECT 's' || page_id AS domain, unnest(['Item ' || page_id, 'Two']) AS title, unnest(['https://f/' || page_id, 'urn:2']) AS url FROM pages")
def feeds_read(spark: SparkSession, d: str) -> DataFrame:
    said = "<rss><channel><title>No</title><item><title>Item %d</title><link>https://f/%d</link><pubDate>x</pubDate></item><item><title>Two</title><guid>urn:2</guid></item></channel></rss>"
    return site_files.feed_entries(_files(spark, d, said, F.col("page_id"), F.col("page_id"))).select("domain", "title", "url")


@_query("feeds_announced", "SELECT url, '/feed/' || page_id AS feed FROM pages")
def feeds_announced(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("<link rel='alternate' type='application/rss+xml' href='/feed/"), F.col("page_id").cast("string"), F.lit("'><link rel='x' href='/no'>"))
    return site_files.feed_links(table(spark, d, "pages").select("url", F.concat(head, "html").alias("html")))


@_query("html_heads", "SELECT page_id FROM pages WHERE page_id % 4 IN (1, 2)")
def html_heads(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 3, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 4 == 0, "image/png").when(F.col("page_id") % 4 == 1, "Text/HTML; charset=utf-8").alias("content_type"))
    return urls.html_pages(heads).select("page_id")


@_query("results_as_text", "SELECT rtrim(rpad(p_partkey::VARCHAR, greatest((SELECT max(length(p_partkey::VARCHAR)) FROM part), 9)::INT, ' ') || '  ' || rpad(p_brand, greatest((SELECT max(length(p_brand)) FROM part), 7)::INT, ' ') || '  ' || CASE WHEN p_size % 2 = 0 THEN '-' ELSE p_size::VARCHAR END) AS value FROM part")
def results_as_text(spark: SparkSession, d: str) -> DataFrame:
    return results.text_rows(table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("odd")))


@_query("results_as_json", """SELECT '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","odd":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE p_size::VARCHAR END || '}' AS value FROM part""")
def results_as_json(spark: SparkSession, d: str) -> DataFrame:
    return results.json_rows(table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("odd")))


# --- pages with commerce markup, made from the pages' ids


def _marked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"P'), n, F.lit('","offers":{"price":"'), n, F.lit('.5","priceCurrency":"EUR","availability":"https://schema.org/InStock"},"aggregateRating":{"ratingValue":4,"bestRating":5,"reviewCount":7}}</script>'))
    head = F.concat(F.lit("<html><head><title>T</title><meta property='og:image' content='i'>"), ld, F.lit("</head><body>"))
    form = F.lit('<form action="/find" method="get"><input name="q" required><input type="hidden" name="ref"></form><a href="/x">Log in</a><button>Add to cart</button>')
    code = F.concat(F.lit('<script>fetch("/api/a/'), n, F.lit("\", {method: 'post'}); fetch('/plain'); axios.put('/ax', 1); $.ajax({url: '/jq', type: 'DELETE'}); x.open('GET', '/xhr'); g('/graphql'); h('/v2/items'); new WebSocket('wss://s.test/"), n, F.lit("'); io('https://io.test'); new SockJS('/sj'); b.withUrl('/hub')</script>"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://shop.test/dp/"), n).alias("url"), F.concat(head, form, code, F.lit("<div draggable=\"true\">a</div><div ondrop=\"x()\"></div></body></html>")).alias("html"))


def _marked_data(spark: SparkSession, d: str) -> DataFrame:
    return html_data.structured(_marked(spark, d), ("page_id",))


@_query("products_in_pages", "SELECT page_id, 'P' || page_id AS name, page_id + 0.5::DOUBLE AS price, 'EUR' AS currency, 'InStock' AS availability, 4.0::DOUBLE AS rating, 7 AS reviews, 1 AS forms, 2 AS form_fields FROM pages")
def products_in_pages(spark: SparkSession, d: str) -> DataFrame:
    p, form = F.get("products", F.lit(0)), F.get("forms", F.lit(0))
    return _marked_data(spark, d).select("page_id", p["name"].alias("name"), p["price"].alias("price"), p["currency"].alias("currency"), p["availability"].alias("availability"), p["rating"].alias("rating"), p["reviews"].cast("int").alias("reviews"), F.size("forms").alias("forms"), F.size(form["fields"]).alias("form_fields"))


@_query("product_features", "SELECT 'https://shop.test/dp/' || page_id AS url, 4 AS page_type, 242 AS confidence, round((page_id + 0.5::DOUBLE)::FLOAT::DOUBLE, 2) AS price, 0.8::DOUBLE AS rating, 1.0::DOUBLE AS availability, 1.0::DOUBLE AS structured, 1.0::DOUBLE AS https, 225 AS flags FROM pages")
def product_features(spark: SparkSession, d: str) -> DataFrame:
    f = lambda i: F.round(F.get("features", F.lit(i)).cast("double"), 2)
    return html_data.nodes(_marked_data(spark, d)).select("url", "page_type", "confidence", f(48).alias("price"), f(52).alias("rating"), f(51).alias("availability"), f(13).alias("structured"), f(8).alias("https"), "flags")


@_query("actions_in_pages", "SELECT 'https://shop.test/dp/' || page_id AS url, unnest(['Add to cart', 'Log in']) AS label, unnest([2, 4])::INT AS category, unnest([0, 0])::INT AS action FROM pages")
def actions_in_pages(spark: SparkSession, d: str) -> DataFrame:
    return html_data.page_actions(_marked_data(spark, d)).where("label in ('Add to cart', 'Log in')").select("url", "label", "category", "action")


@_query("script_actions", """
SELECT 'https://shop.test/dp/' || page_id AS url, x.m AS method, 'https://shop.test' || replace(x.e, '#', page_id::VARCHAR) AS endpoint, x.c::DOUBLE AS confidence FROM pages,
(VALUES ('POST', '/api/a/#', 0.80), ('GET', '/plain', 0.70), ('PUT', '/ax', 0.80), ('DELETE', '/jq', 0.75), ('GET', '/api/a/#', 0.60), ('POST', '/graphql', 0.75), ('GET', '/xhr', 0.70), ('GET', '/v2/items', 0.55)) x(m, e, c)""")
def script_actions(spark: SparkSession, d: str) -> DataFrame:
    return html_data.script_actions(_marked_data(spark, d)).select("url", "method", "endpoint", F.col("confidence").cast("double").alias("confidence"))


@_query("sockets_in_pages", "SELECT 'https://shop.test/dp/' || page_id AS url, x.e || CASE WHEN x.p = 'websocket' THEN page_id::VARCHAR ELSE '' END AS endpoint, x.p AS protocol FROM pages, (VALUES ('wss://s.test/', 'websocket'), ('https://io.test', 'socket.io'), ('/sj', 'sockjs'), ('/hub', 'signalr')) x(e, p)")
def sockets_in_pages(spark: SparkSession, d: str) -> DataFrame:
    return html_data.sockets(_marked_data(spark, d))


@_query("drag_in_pages", "SELECT 'https://shop.test/dp/' || page_id AS url, 'html5' AS library, 1 AS items, 1 AS zones FROM pages")
def drag_in_pages(spark: SparkSession, d: str) -> DataFrame:
    return html_data.drag_libraries(_marked(spark, d))


@_query("platform_actions", "SELECT 'https://shop.test/dp/' || page_id AS url, 'p1' AS platform, 'POST' AS method, '/cart/add.js' AS endpoint, 0.9::DOUBLE AS confidence FROM pages")
def platform_actions(spark: SparkSession, d: str) -> DataFrame:
    row = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("platform", "indicator", "method", "endpoint", "confidence"), strict=True)])
    packs = spark.range(1).select(F.inline(F.array(row("p1", "og:image", "POST", "/cart/add.js", 0.9), row("p1", "draggable", "POST", "/cart/add.js", 0.5), row("p2", "no such mark", "GET", "/x", 0.9))))
    return html_data.packed_actions(_marked(spark, d), packs)


@_query("urls_in_pages", "SELECT 'https://shop.test/dp/' || page_id AS url, unnest(['https://shop.test/x', 'https://io.test']) AS found, unnest(['link', 'script']) AS source FROM pages")
def urls_in_pages(spark: SparkSession, d: str) -> DataFrame:
    return html_data.page_urls(_marked_data(spark, d))


@_query("layered_pages", """
SELECT '/p/' || p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'final_url' ELSE 'static' END AS source, CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 5 END::INT AS first, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 6 END::INT AS second, CASE WHEN p_partkey % 3 = 2 THEN 34 ELSE 97 END::INT AS flags FROM part""")
def layered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a static page; two thirds were rendered too, half of those under another address."""
    n = F.col("p_partkey")
    url = F.concat(F.lit("/p/"), n.cast("string"))
    p = table(spark, d, "part")
    static = p.select(url.alias("url"), F.array(F.lit(2.0), F.lit(0.0)).alias("features"), F.when(n % 3 == 2, 32).otherwise(96).alias("flags"), F.lit(0.5).alias("completeness"))
    seen = p.where(n % 3 < 2).select(F.when(n % 3 == 0, url).otherwise(F.concat(F.lit("/old"), url)).alias("url"), F.when(n % 3 == 1, url).alias("final_url"), F.array(F.lit(5.0), F.lit(6.0)).alias("features"), F.lit(1).alias("flags"), F.lit(0.9).alias("completeness"))
    out = html_data.layered(seen, static)
    return out.select("url", "source", F.get("features", F.lit(0)).cast("int").alias("first"), F.get("features", F.lit(1)).cast("int").alias("second"), "flags")


@_query("action_ratios", "SELECT p_partkey::INT AS node_id, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS safe, CASE WHEN p_size % 2 = 0 THEN 0.25 ELSE 0 END::DOUBLE AS cautious, CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0 END::DOUBLE AS number FROM part")
def action_ratios(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    some = table(spark, d, "part").where("p_size % 2 = 0").select(F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("url"), F.explode(F.array(*[F.lit(x) for x in (0, 0, 1, 2)])).alias("risk"))
    f = lambda i: F.round(F.get("features", F.lit(i)).cast("double"), 4)
    return html_data.with_action_ratios(nodes, some).select("node_id", f(97).alias("safe"), f(98).alias("cautious"), f(96).alias("number"))


@_query("site_files_read", "SELECT p_brand AS domain, '/part/' || p_partkey AS url, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS node_id, round(p_retailprice::FLOAT::DOUBLE, 3) AS price FROM part")
def site_files_read(spark: SparkSession, d: str) -> DataFrame:
    """Every site written as one site file in the shared folder and read back."""
    path = graph.shared_path(spark, "sites")
    site_files.ctx_files(_part_nodes(spark, d)).write.parquet(path)
    out = site_files.ctx_rows(spread(spark.read.parquet(path)))  # a batch has all sites of a task
    return out.select("domain", "url", "node_id", F.round(F.get("features", F.lit(48)).cast("double"), 3).alias("price"))


# --- streams, run to the end of what is there


@_query("stream_sessions", """
WITH g AS (SELECT event_type, ts, sum(CASE WHEN p IS NULL OR epoch(ts) - epoch(p) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events))
SELECT event_type, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM g GROUP BY event_type, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, feeds.session_stream(_event_stream(spark, d), ["event_type"], "1 hour"), "complete")
    return out.select("event_type", F.unix_micros("start").alias("start"), "n")


@_query("stream_of_domain", "SELECT event_id FROM events WHERE user_id = 3 OR event_type = 'login'")
def stream_of_domain(spark: SparkSession, d: str) -> DataFrame:
    named = _event_stream(spark, d).select("event_id", F.col("user_id").cast("string").alias("domain"), F.when(F.col("event_type") == "login", "maintenance").otherwise(F.col("event_type")).alias("type"))
    return _drained(spark, feeds.for_domain(named, "3").select("event_id"), "append")


@_query("stream_rotated", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_rotated(spark: SparkSession, d: str) -> DataFrame:
    at = graph.shared_path(spark, "audit")
    feeds.append_rotating(_event_stream(spark, d).select("event_type", "event_id"), f"{at}/log", f"{at}/checkpoint", 2).awaitTermination()
    return spark.read.schema("event_type string, event_id long, part int, batch int").json(f"{at}/log").groupBy("event_type").agg(F.count("*").alias("n"))


@_query("stream_collected", "SELECT user_id, event_id FROM events")
def stream_collected(spark: SparkSession, d: str) -> DataFrame:
    """One batch: nothing is collected before the first tick."""
    at = graph.shared_path(spark, "gathered")
    feeds.collected_every(_event_stream(spark, d).select("user_id", "event_id", "ts"), f"{at}/rows", f"{at}/checkpoint", ["user_id"], 120).awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("user_id", "event_id")


@_query("stream_changed", "SELECT event_id FROM (SELECT event_type, user_id, ts, event_id, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS b FROM events) WHERE event_type IN ('click', 'view') AND abs(value - b) > 50")
def stream_changed(spark: SparkSession, d: str) -> DataFrame:
    points = _event_stream(spark, d).select(F.lit("s").alias("domain"), F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("field"), "ts", "value")
    out = _drained(spark, feeds.changed_steps(points, ["click", "view"], 50.0), "append")
    back = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("field"), F.col("ts").cast("timestamp").alias("ts"))
    return out.join(back, ["url", "field", "ts"]).select("event_id")
