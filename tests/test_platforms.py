"""Many patterns at once, and the packs."""

import random

import pytest
from pyspark.sql import functions as F

from meshquery.functions import multipattern
from meshquery.sources import dom, platforms


def test_patterns_against_contains(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé日 ") for _ in range(rng.randrange(1, n)))
    texts = [word(40) for _ in range(200)] + [None, "", "a" * 100_000]
    patterns = [word(4) for _ in range(60)] + ["a", "a", "aa" * 200, "zzz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(frame.select("i", multipattern.found_in(F.col("t"), patterns)).collect())
    assert all(got[i] == (None if t is None else [k for k, p in enumerate(patterns) if p in t]) for i, t in enumerate(texts))
    assert [r[0] for r in frame.limit(2).select(F.size(multipattern.found_in(F.col("t"), []))).collect()] == [0, 0]
    with pytest.raises(ValueError):
        multipattern.found_in(F.col("t"), ["a", ""])
    with pytest.raises(ValueError):
        multipattern.found_in(F.col("t"), ["a" * (17 << 20)])


def test_the_most_specific_platform_counts(spark):
    htmls = ["x wp-includes and woocommerce", "/wp-content/ Shopify.shop", "nothing", None, "_next/static wp-json", "wp-json"]
    frame = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    assert [r[1] for r in frame.select("i", platforms.platform_of(F.col("html"))).orderBy("i").collect()] == ["woocommerce", "shopify", None, None, "nextjs_commerce", "wordpress"]
    assert platforms.platform_requests(frame, "i").groupBy("i").count().orderBy("i").collect() == [(0, 3), (1, 4), (4, 1), (5, 2)]


def test_form_requests_by_hand(spark):
    html = (
        '<form action="/cart/add" method="post" enctype="multipart/form-data"><input name="id" value="7" required><button>Go</button><input type="submit" value="Later"></form>'
        '<form action="https://x.org/signin"><button></button></form><form><input type=submit value="Join our Newsletter"></form>'
    )
    pages = dom.parsed(spark.createDataFrame([("https://s.test/a/", html)], "url string, html string"), "url")
    got = {r.endpoint: r for r in platforms.form_requests(pages).collect()}
    one = got["https://s.test/cart/add"]
    assert (one.label, one.category, one.action, one.method, one.content_type, [tuple(f) for f in one.fields]) == ("Go", 2, 0, "POST", "multipart/form-data", [("id", "input", "7", True), ("", "", "", False)][:1])
    two = got["https://x.org/signin"]
    assert (two.label, two.category, two.action) == ("Form → https://x.org/signin", 4, 1)
    assert (got["https://s.test/a/"].label, got["https://s.test/a/"].action) == ("Join our Newsletter", 3)


def test_sockets_by_hand(spark):
    rows = [(1, "discord.com", "new WebSocket('wss://gateway.discord.gg/?v=10&encoding=json')"), (2, "", "x.withUrl('/hub')"), (3, None, 'io("http://a.b/") io("http://a.b/")'), (4, "google", "signalR.withUrl('/hub')")]
    got = sorted((r.i, r.endpoint, r.protocol, r.source, r.confidence) for r in platforms.socket_endpoints(spark.createDataFrame(rows, "i int, domain string, html string"), "i").collect())
    assert got == [
        (1, "wss://gateway.discord.gg/?v=10&encoding=json", "raw", "platform:discord.com", 0.95), (3, "ws://a.b/", "socketio", "html", 0.85),
        (4, "/hub", "signalr", "html", 0.85), (4, "wss://{project}.firebaseio.com/.ws", "raw", "platform:firebase.google.com", 0.95),
    ]
