"""Queries of page features and of whole site maps: over the given pages, and over sites that Spark renders from suppliers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import page_queries  # noqa: F401  (adds its queries first)
from .catalog import DIM
from .catalog_queries import _query, spread, table
from .functions import urls
from .operators import graph, site_map
from .sources import dom, encoders, html_data


def _dim(name: str, digits: int = 4):
    return F.round(F.get("features", F.lit(DIM[name])).cast("double"), digits)


@_query("page_content_features", r"""
    WITH t AS (SELECT page_id, html, url, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path, len(regexp_extract_all(html, '<a href="/')) AS links FROM pages)
    SELECT page_id, round(least(len(regexp_extract_all(html, '<h[1-6]')) / 10.0, 1)::DOUBLE, 4) AS headings, round(least(len(regexp_extract_all(html, '<p[ >]')) / 20.0, 1)::DOUBLE, 4) AS paragraphs,
           round(least(len(regexp_extract_all(html, '<[uo]l[ >]')) / 10.0, 1)::DOUBLE, 4) AS lists, round(least(links / 100.0, 1)::DOUBLE, 4) AS inner_links, 0.0::DOUBLE AS outer_links, round(least(links / 100.0, 1)::DOUBLE, 4) AS outbound,
           (CASE WHEN links = 0 THEN 1 ELSE 0 END)::DOUBLE AS dead_end, (CASE WHEN url LIKE 'https://%' THEN 1 ELSE 0 END)::DOUBLE AS https, round((len(list_filter(string_split(path, '/'), lambda s: s <> '')) / 10.0)::DOUBLE, 4) AS depth,
           (CASE WHEN url LIKE '%?%' THEN 1 ELSE 0 END)::DOUBLE AS has_query, (CASE WHEN url LIKE '%#%' THEN 1 ELSE 0 END)::DOUBLE AS has_fragment, 1 AS flags
    FROM t""")
def page_content_features(spark: SparkSession, d: str) -> DataFrame:
    shown = encoders.rendered(dom.parsed(table(spark, d, "pages"), "page_id", "url"), "page_id")
    names = {"headings": "heading_count", "paragraphs": "paragraph_count", "lists": "list_count", "inner_links": "link_count_internal", "outer_links": "link_count_external", "outbound": "outbound_links", "dead_end": "is_dead_end", "https": "is_https", "depth": "url_path_depth", "has_query": "url_has_query", "has_fragment": "url_has_fragment"}
    # a price in a page's made-up text would be one more flag
    return shown.select("page_id", *[_dim(v).alias(k) for k, v in names.items()], F.col("flags").bitwiseAND(F.lit(0b10100001)).alias("flags"))


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """A page per supplier, dealt to all tasks before it is rendered."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key, at = F.col("s_suppkey").cast("string"), said("https://n", F.col("s_nationkey").cast("string"), ".test")
    ld = said('{"@graph": [{"@type": "Product", "name": "x", "offers": {"price": ', (F.col("s_suppkey") + 0.5).cast("string"), '}}, {"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "item": "', at, '/start"}, {"position": 2, "item": "', F.col("url"), '"}]}]}')
    html = said('<html><head><script type="application/ld+json">', ld, '</script><meta name="robots" content="', F.when(F.col("s_suppkey") % 4 == 0, "noindex").otherwise("all"), '"></head><body><h1>', F.col("s_name"), '</h1><u data-reviews="5"></u><a href="/start">all</a></body></html>')
    return spread(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")).withColumn("url", said(at, "/product/", key)).select("s_suppkey", "url", html.alias("html"))


def supplier_sites(spark: SparkSession, d: str, most: int | None = None) -> site_map.SiteMap:
    """A site per nation: a fetched page per supplier, a rendered start page, a cart of which only the address is known."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pages = _fetched(spark, d)
    homes = table(spark, d, "nation").select(said("https://n", F.col("n_nationkey").cast("string"), ".test").alias("at"), "n_name")
    starts = homes.select(said(F.col("at"), "/").alias("url"), said(F.col("at"), "/start").alias("final_url"), said("<body><h1>", F.col("n_name"), '</h1><p>one<p>two<a href="/cart">cart</a></body>').alias("html"))
    site = urls.site(F.col("url"))
    data = graph.written(html_data.structured(pages), "data")  # read three times
    shown = encoders.rendered(dom.parsed(starts, "url", "final_url"), "final_url").withColumn("domain", site)
    found = encoders.from_patterns(dom.parsed(pages, "url")).withColumn("domain", site)
    asked = pages.select(site.alias("domain"), "url", F.lit(2).alias("category"), F.lit(0).alias("action"), F.when(F.col("s_suppkey") % 3 == 0, 0.9).otherwise(0.5).alias("confidence"), (F.col("s_suppkey") % 2 == 0).alias("is_plain"))
    links = data.select(site.alias("domain"), "url", F.explode("links").alias("l")).where("l.internal").select("domain", "url", F.col("l.url").alias("target"))
    crumbs = data.select(site.alias("domain"), "url", F.explode("breadcrumbs").alias("c")).select("domain", "url", "c.position", F.col("c.url").alias("target"))
    addresses = homes.select(said(F.col("at"), "/cart").alias("url")).unionByName(pages.select("url")).withColumn("domain", site)
    return site_map.build(addresses, html_data.nodes(data, meta=True), shown, found, asked, links, crumbs, most)


_MAP = """
    s AS (SELECT s_suppkey AS k, s_nationkey AS d, 'https://n' || s_nationkey || '.test/product/' || s_suppkey AS url FROM supplier),
    f AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY url) - 1 AS id, count(*) OVER (PARTITION BY d) AS n FROM s),
    h AS (SELECT n_nationkey AS d, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS id FROM nation),
    ring AS (SELECT d, id AS a, coalesce(lead(id) OVER (PARTITION BY d ORDER BY id), 0) AS b FROM f WHERE n BETWEEN 2 AND 100),
    e AS (
        SELECT f.d, f.id AS src, h.id AS dst, 1 AS edge_type, 1 AS weight FROM f JOIN h USING (d) UNION ALL SELECT f.d, h.id, f.id, 1, 2 FROM f JOIN h USING (d) UNION ALL SELECT f.d, h.id, f.id, 4, 1 FROM f JOIN h USING (d)
        UNION ALL SELECT f.d, h.id, f.id, 0, 2 FROM f JOIN h USING (d) UNION ALL SELECT f.d, f.id, h.id, 0, 3 FROM f JOIN h USING (d) UNION ALL SELECT d, id, id + 1, 0, 2 FROM h UNION ALL SELECT d, id + 1, id, 0, 3 FROM h
        UNION ALL SELECT d, a, b, 0, 1 FROM ring WHERE a < 20
    )"""


@_query("site_map_nodes", f"""
    WITH {_MAP}, n AS (
        SELECT d, id, url, 4 AS page_type, 242 AS confidence, 64 AS flags, k + 0.5::DOUBLE AS price, round(ln(6) / 10, 4) AS reviews, 0.05::DOUBLE AS acts, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS safe, (CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END)::DOUBLE AS cautious, 1.0::DOUBLE AS called, 0.1::DOUBLE AS headings, 0.0::DOUBLE AS paragraphs, (CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END)::DOUBLE AS indexed FROM f
        UNION ALL SELECT d, id, 'https://n' || d || '.test/', 1, 229, 1, 0, 0, 0.05, 1, 0, 1, 0.1, 0.1, 0 FROM h  -- its link to the cart is an action
        UNION ALL SELECT d, id + 1, 'https://n' || d || '.test/cart', 10, 229, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM h
    )
    SELECT 'n' || d || '.test' AS domain, id::INT AS node_id, url, page_type, confidence, flags, price, reviews, acts, safe, cautious, called, headings, paragraphs, indexed,
           (SELECT count(*) FROM e WHERE e.d = n.d AND e.dst = n.id)::INT AS inbound, (SELECT count(*) FROM e WHERE e.d = n.d AND e.src = n.id)::INT AS outbound FROM n""")
def site_map_nodes(spark: SparkSession, d: str) -> DataFrame:
    names = {"price": "price", "reviews": "review_count_log", "acts": "action_count", "safe": "safe_action_ratio", "cautious": "cautious_action_ratio", "called": "primary_cta_present", "headings": "heading_count", "paragraphs": "paragraph_count", "indexed": "meta_robots_index"}
    nodes = supplier_sites(spark, d).nodes
    return nodes.select("domain", "node_id", "url", "page_type", "confidence", "flags", *[_dim(v).alias(k) for k, v in names.items()], F.col("inbound_count").cast("int").alias("inbound"), F.col("outbound_count").cast("int").alias("outbound"))


@_query("site_map_edges", f"WITH {_MAP} SELECT 'n' || d || '.test' AS domain, src::INT AS src, dst::INT AS dst, edge_type, weight FROM e")
def site_map_edges(spark: SparkSession, d: str) -> DataFrame:
    return supplier_sites(spark, d).edges.select("domain", "src", "dst", "edge_type", "weight")


@_query("site_map_actions", f"WITH {_MAP} SELECT 'n' || d || '.test' AS domain, id::INT AS node_id, 2 AS category, 0 AS action, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS risk, true AS http_executable FROM f")
def site_map_actions(spark: SparkSession, d: str) -> DataFrame:
    return supplier_sites(spark, d).actions.select("domain", "node_id", "category", "action", "risk", "http_executable")
