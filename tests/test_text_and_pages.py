import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquery.catalog import DIM, NODE_FLAGS, PAGE_TYPE
from meshquery.functions import text, urls
from meshquery.sources import html_data, site_files


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_personal_data(spark):
    said = ["mail hello@example.com now", "ssn 123-45-6789.", "card 4111-1111-1111-1111!", "plain text", "é a@b.co and 555-123-4567"]
    found = column(spark, said, text.pii_matches)
    assert [[m.type for m in x] for x in found] == [["email"], ["ssn"], ["credit_card"], [], ["email", "phone"]]
    assert column(spark, said, text.has_pii) == [True, True, True, False, True]
    df = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    for r in text.pii_spans(df, ["i"]).collect():
        assert said[r.i][r.start : r.end] in ("hello@example.com", "123-45-6789", "4111-1111-1111-1111", "a@b.co", "555-123-4567")


def test_threats(spark):
    assert column(spark, ["<script>alert(1)</script>", "../../etc/passwd", "John Doe", "x' OR 1=1 --", "select a from b", "<p onclick = x>"], text.threats) == [["script_injection"], ["path_traversal"], [], ["sql_injection"], ["sql_injection"], ["event_handler"]]
    assert column(spark, ["<p onclick=x>../a"], text.sanitized) == ["<p x>a"]


def test_prices_and_ratings(spark):
    assert column(spark, ["$1,299.99", "200 - 350", "From $5", "", "free", "1.2.3"], text.price_low) == [1299.99, 200.0, 5.0, None, None, None]
    assert column(spark, ["1.234,56 €", "1,234.56", "29,99", "1,234", "0", "$ 7"], text.price_either) == [1234.56, 1234.56, 29.99, 1234.0, None, 7.0]
    assert column(spark, ["Excellent", "87%", "4.5", "8", "very good", "?"], text.rating_of) == [1.0, 0.87, 0.9, 0.8, 0.9, 0.0]
    assert column(spark, ["In Stock", "Currently unavailable", "pre-order", "?"], text.availability_of) == [1.0, 0.0, 0.5, None]
    assert column(spark, ["5 € or $6", "none"], text.currency_in) == ["EUR", None]
    assert column(spark, [4.0, 8.0, 80.0], text.rating_scale, "double") == [5.0, 10.0, 100.0]


def test_names_and_actions(spark):
    assert column(spark, ["cost", "stars", "other"], text.canonical_field) == ["price", "rating", "other"]
    assert column(spark, ["ForumPost", "FAQ"], text.snake_case) == ["forum_post", "f_a_q"] and column(spark, ["forum_post"], text.camel_case) == ["forumPost"]
    assert column(spark, ["box", "city", "day", "cart"], text.plural) == ["boxes", "cities", "days", "carts"]
    got = column(spark, ["Add to Cart", "Remove from cart", "Sign in", "Play", None, "whatever"], lambda c: text.action_code(c, F.lit("button")))
    assert [tuple(x) for x in got] == [(2, 0), (2, 1), (4, 0), (5, 0), (0, 1), (0, 1)]
    assert column(spark, ["big product-page x", "none"], text.page_type_in) == [PAGE_TYPE["product_detail"], None]


def test_urls(spark):
    known = [("https://a.com/", "home"), ("https://a.com", "home"), ("https://a.com/dp/B01", "product_detail"), ("https://a.com/blog/x", "article"), ("https://a.com/about-us", "about_page"), ("https://a.com/contact", "contact_page"), ("https://a.com/cart", "cart"), ("https://a.com/checkout/1", "checkout"), ("https://a.com/login", "login"), ("https://a.com/xyz", "unknown")]
    got = column(spark, [u for u, _ in known], urls.classify)
    assert [x.page_type for x in got] == [PAGE_TYPE[k] for _, k in known]
    assert column(spark, ["https://a.com/x/y/?q#f", "https://a.com"], urls.path_depth) == [2, 0]
    assert column(spark, ["https://a.com/x/y/", "https://a.com/x", "https://a.com/"], urls.parent_path) == ["/x", "/", None]
    assert column(spark, ["HTTPS://www.Shop.com:80/x", "Shop.com/y"], urls.normal_domain) == ["shop.com", "shop.com"]
    joined = spark.createDataFrame([("https://a.com/x/y", "../z?q"), ("https://a.com", None)], "b string, r string").select(urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    assert [r.u for r in joined] == ["https://a.com/z?q", None]


def test_robots(spark):
    said = "# x\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /exact$\nCrawl-delay: 2\nSitemap: http://a/s.xml\n\nUser-agent: bad\nUser-agent: worse\nDisallow: /"
    assert site_files.robots(said)["delay"] == 2.0 and site_files.robots(said, "WorseBot")["rules"] == [("disallow", "/")]
    rules = site_files.robots_rules(spark.createDataFrame([("a", said)], "domain string, text string"))
    pages = spark.createDataFrame([("a", f"http://a{p}") for p in ("/private/x", "/private/open/y", "/exact", "/exact/no", "/")] + [("b", "http://b/private")], "domain string, url string")
    assert {r.url: r.allowed for r in urls.robots_allowed(pages, rules).collect()} == {"http://a/private/x": False, "http://a/private/open/y": True, "http://a/exact": False, "http://a/exact/no": True, "http://a/": True, "http://b/private": True}


def test_sitemaps_and_feeds(spark):
    one = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/1 </loc><lastmod>2024-01-02</lastmod><priority>0.8</priority></url><url><loc>http://a/2</loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>http://a/s1.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("a", one), ("b", index), ("c", "not xml"), ("d", None)], "domain string, text string")
    got = sorted((r.url, r.priority, str(r.lastmod)) for r in site_files.sitemap_entries(files).collect())
    assert got == [("http://a/1", 0.8, "2024-01-02 00:00:00"), ("http://a/2", 0.5, "None"), ("http://a/s1.xml", 1.0, "None")]
    rss = "<rss><channel><item><title>T</title><link>http://a/n</link><pubDate>x</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>U</title><link href="http://b/n"/><updated>y</updated></entry></feed>'
    feeds = spark.createDataFrame([("a", rss), ("b", atom)], "domain string, text string")
    assert sorted((r.title, r.url) for r in site_files.feed_entries(feeds).collect()) == [("T", "http://a/n"), ("U", "http://b/n")]


def site():
    rng = np.random.default_rng(1)
    n = 10
    return {"domain": "shop.com", "mapped_at": 1700000000, "urls": [f"https://shop.com/é/{i}" for i in range(n)], "nodes": [(4, 200, 255, 1, i, 0, 200, 2, 1, 2, 1.5) for i in range(n)], "features": rng.normal(size=(n, 128)), "edges": [(i, (i + 1) % n, 1, 1, 0) for i in range(n)] + [(0, i, 3, 2, 4) for i in range(5, 10)], "actions": [(2, 0x0200, -1, 1, 0), (7, 0x0400, 3, 2, 1)], "centroids": rng.normal(size=(2, 128))}


def test_site_files_round_trip(spark, tmp_path):
    data = site_files.ctx_bytes(site())
    (tmp_path / "a.ctx").write_bytes(data)
    n = site_files.read_ctx(spark, str(tmp_path)).orderBy("node_id").collect()
    assert len(n) == 10 and n[3].url == "https://shop.com/é/3" and np.allclose(n[3].features, np.float32(site()["features"][3]))
    e = {(r.src, r.dst, r.edge_type, r.weight, r.flags) for r in site_files.read_ctx(spark, str(tmp_path), "edges").collect()}
    assert e == set(site()["edges"])
    assert {(r.node_id, r.category, r.action, r.target_node) for r in site_files.read_ctx(spark, str(tmp_path), "actions").collect()} == {(2, 2, 0, -1), (7, 4, 0, 3)}
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(site_files.BadFile, match="checksum"):
        site_files.ctx_site(bytes(broken))
    with pytest.raises(site_files.BadFile):
        site_files.ctx_site(data[:-20])


def test_observation_files(spark, tmp_path):
    rows = [{"id": i, "timestamp": 1700000000 + i, "session_id": 1, "embedding": [0.5, i], "metadata": {"labels": ["a"], "description": None}, "memory_link": None} for i in range(3)]
    (tmp_path / "a.avis").write_bytes(site_files.avis_bytes(rows, 2, 1))
    got = site_files.read_avis(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.embedding for r in got] == [[0.5, float(i)] for i in range(3)] and got[0].labels == ["a"] and got[0].memory_link is None


PRODUCT = """<html lang=en><head><title>W</title><meta name=description content="A widget"><meta property="og:image" content="i.png">
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product","name":"Widget","offers":{"price":"29.99","priceCurrency":"USD","availability":"https://schema.org/InStock"},
"aggregateRating":{"ratingValue":4.5,"bestRating":5,"reviewCount":128}},{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Home","item":"https://x.com/"}]}]}</script></head>
<body><h1>Widget</h1><a href="/other">Other</a><a href="https://y.com/" rel=nofollow>Out</a><form action="/search"><input name=q required><input type=hidden name=ref><button>Search</button></form>
<script>fetch('/api/items'); new WebSocket("wss://x.com/live"); var a = "/api/more";</script></body></html>"""


def test_structured_data(spark):
    pages = spark.createDataFrame([("https://x.com/p/1", PRODUCT), ("https://x.com/b", "<p class=price>$1,299.50</p><div class='in-stock'>4.5 out of 5"), ("https://x.com/c", None), ("u", "<div itemtype='http://schema.org/Product' itemscope><b itemprop=name>N</b><meta itemprop=price content='7,50'></div>")], "url string, html string")
    data = html_data.structured(pages)
    rows = {r.url: r for r in data.collect()}
    p = rows["https://x.com/p/1"]
    assert p.products[0].price == 29.99 and p.products[0].reviews == 128 and p.products[0].availability == "InStock" and p.schema_type == "Product" and p.breadcrumbs[0].name == "Home"
    assert [(x.url, x.internal) for x in p.links] == [("https://x.com/other", True), ("https://y.com/", False)] and [f.name for f in p.forms[0].fields] == ["q", "ref"] and p.forms[0].fields[0].required
    b = rows["https://x.com/b"].pattern
    assert (b.price, b.price_confidence, b.rating, b.rating_confidence, b.availability, b.availability_confidence) == (1299.5, 0.85, 4.5, 0.85, 1.0, 0.9)
    assert rows["u"].has_microdata and rows["u"].products[0].price == 7.5 and rows["https://x.com/c"].links == []
    n = {r.url: r for r in html_data.nodes(data).collect()}["https://x.com/p/1"]
    assert n.page_type == PAGE_TYPE["product_detail"] and n.features[DIM["price"]] == pytest.approx(29.99, 1e-6) and n.features[DIM["rating"]] == pytest.approx(0.9) and n.features[DIM["availability"]] == 1.0
    assert n.flags & NODE_FLAGS["has_price"] and n.flags & NODE_FLAGS["has_form"] and n.flags & NODE_FLAGS["has_media"] and n.completeness == pytest.approx(1.0)
    acts = {(r.label, r.category, r.action) for r in html_data.page_actions(data.where("url = 'https://x.com/p/1'")).collect()}
    assert ("Search", 1, 0) in acts and ("/search", 3, 5) in acts
    assert {r.endpoint: r.confidence for r in html_data.api_calls(data).collect()} == {"/api/items": 0.8, "/api/more": 0.55}
    assert [tuple(r)[1:] for r in html_data.sockets(data).collect()] == [("wss://x.com/live", "websocket")]


def test_rule_packs_and_page_urls(spark):
    pages = spark.createDataFrame([("https://x.com/", '<html><link rel=canonical href="https://x.com/c"><script src="cdn.shop.js"></script><a href="/a">A</a><a href="/a">A</a><script>var u = "https://x.com/a", v = "https://x.com/s";</script><li draggable="true" ondrop=x>'), ("https://y.com/", None)], "url string, html string")
    packs = spark.createDataFrame([("shop", "cdn.shop", "POST", "/cart/add", 0.8), ("shop", "shop.js", "POST", "/cart/add", 0.9), ("other", "nothing", "GET", "/x", 0.5)], "platform string, indicator string, method string, endpoint string, confidence double")
    assert [tuple(r)[1:] for r in html_data.packed_actions(pages, packs).collect()] == [("shop", "POST", "/cart/add", 0.9)]
    assert [tuple(r)[1:] for r in html_data.drag_libraries(pages).collect()] == [("html5", 1, 1)]
    got = {r.found: r.source for r in html_data.page_urls(html_data.structured(pages)).collect()}
    assert got == {"https://x.com/a": "link", "https://x.com/c": "canonical", "https://x.com/s": "script"}


def test_addresses_in_long_runs(spark):
    import random
    import re
    import time

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@.-_ co") for _ in range(60)) for _ in range(400)] + ["x@y.co_z@w.com", "a@b.comc@d.org", "@a.co", "a@b.c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(frame.select("i", F.transform(F.filter(text.pii_matches(F.col("t")), lambda m: m["type"] == "email"), lambda m: m["match"])).collect())
    assert all(got[i] == re.findall(text.PII["email"], t) for i, t in enumerate(texts))
    start = time.time()
    long = spark.createDataFrame([("A" * 1_000_000 + " x@y.org",), ("a" * 500_000 + "@",)], "t string")
    assert [r[0] for r in long.select(text.has_pii(F.col("t"))).collect()] == [True, False] and time.time() - start < 20


def test_page_nodes_take_no_price_from_free_text(spark, tmp_path):
    from meshquery import catalog_queries

    pages = [(1, "https://x.com/a", '<html lang="en"><p>onndan$$$ 1142126 and 3/5, in stock</p>'), (2, "https://x.com/b", '<html lang="en"><b class="price">$ 7</b>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.url[-1]: r for r in catalog_queries.queries()["page_nodes"](spark, str(tmp_path)).collect()}
    assert got["a"].flags == NODE_FLAGS["rendered"] and [got["a"].features[DIM[c]] for c in ("price", "rating", "availability")] == [0, 0, 0]
    assert got["b"].flags & NODE_FLAGS["has_price"] and got["b"].features[DIM["price"]] == 7.0
    data = html_data.structured(spark.read.parquet(str(tmp_path / "pages.parquet")))
    assert {r.url[-1]: r.flags & NODE_FLAGS["has_price"] > 0 for r in html_data.nodes(data).collect()} == {"a": True, "b": True}  # the operator's own reading stays


def test_a_large_site_is_read_in_slices(spark):
    import numpy as np

    rows, n = site_files.site_rows, 25_000
    table = np.zeros(n, dtype=site_files.NODE)
    table["page_type"] = np.arange(n) % 7
    data = site_files.ctx_bytes({"domain": "x.com", "nodes": table, "features": np.zeros((n, 128)), "urls": [f"/{i}" for i in range(n)]})
    assert data == site_files.ctx_bytes({"domain": "x.com", "nodes": [tuple(r)[:-1] for r in table.tolist()], "features": np.zeros((n, 128)), "urls": [f"/{i}" for i in range(n)]})
    whole = rows(site_files.ctx_site(data), "nodes")
    got = spark.createDataFrame([(data,)], "content binary")
    counts = site_files.ctx_rows(got).select("node_id", "url", "page_type").toPandas()
    assert counts.url.tolist() == whole.url.tolist() and counts.node_id.tolist() == list(range(n)) and counts.page_type.tolist() == whole.page_type.tolist()
    assert len(rows(site_files.ctx_site(data), "nodes", slice(0, 10_000))) == 10_000
