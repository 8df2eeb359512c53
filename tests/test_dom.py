"""Elements and selectors against a plain matcher that walks each page's tree, and the passes by hand."""

import random

import pytest
from pyspark.sql import functions as F

from meshquery.sources import dom, selectors

WORDS = ["a", "b", "c", "li", "p", "ul", "x-y"]


def page(seed, n=60):
    rng = random.Random(seed)
    out, open_ = ["<body>"], []
    for _ in range(n):
        if open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        else:
            tag = rng.choice(["div", "span", "b", "i", "section"])
            extra = (f' id="{rng.choice(WORDS)}"' if rng.random() < 0.2 else "") + (f' class="{rng.choice(WORDS)} {rng.choice(WORDS)}"' if rng.random() < 0.5 else "") + (f' data-k="{rng.choice(["", "en", "en-US", "x en", "xen"])}"' if rng.random() < 0.4 else "")
            out.append(f"<{tag}{extra}>t{rng.randrange(9)}")
            open_.append(tag)
    return "".join(out)


def fits(e, c):
    attrs = dict(e["attrs"])
    for t in c["tests"]:
        have, want = attrs.get(t["name"]), t["value"]
        ok = have is not None and {
            "": True, "=": have == want, "~=": want in (have or "").split() and want != "", "|=": have == want or (have or "").startswith(want + "-"),
            "^=": want != "" and (have or "").startswith(want), "$=": want != "" and (have or "").endswith(want), "*=": want != "" and want in (have or ""),
        }[t["op"]]
        if not ok:
            return False
    return (c["tag"] in (None, e["tag"])) and (c["id"] in (None, e["id"])) and set(c["classes"]) <= set(e["classes"])


def walk(elements, chain, e):
    """Whether e ends the chain."""
    if not fits(e, chain[-1]):
        return False
    if len(chain) == 1:
        return True
    kind, rest = chain[-1]["combinator"], chain[:-1]
    above = []
    at = e["parent"]
    while at >= 0:
        above.append(elements[at])
        at = elements[at]["parent"]
    before = [x for x in elements if x["parent"] == e["parent"] and x["pre"] < e["pre"]]
    near = {" ": above, ">": above[:1], "~": before, "+": before[-1:]}[kind]
    return any(walk(elements, rest, x) for x in near)


SELECTORS = [
    "div", "*", "#a", ".b", "div.c", "div span", "div > span", "span + b", "span ~ b", "body div i", "div > span > b", "section div > b ~ i", "div, .a, #c", "[data-k]", "[data-k=en]", "[data-k~='en']",
    '[data-k|="en"]', "[data-k^=x]", "[data-k$=US]", "[data-k*=e] .a", "[data-k='']", "div div div div", "i + i + i", ".a.b", "b#p, * > #li", "x-y", "div ~ div div, div > div",
]


def test_selectors_against_a_plain_matcher(spark):
    pages = {i: page(i) for i in range(12)} | {50: "", 51: None, 52: "only text & more", 53: "<div>" * 300 + "deep", 54: "</b></i><div", 55: "<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>1<td>2<tr><td>3</table>"}
    parsed = dom.parsed(spark.createDataFrame(list(pages.items()), "key int, html string"), "key")
    keys = {r.page: r.key for r in parsed.collect()}
    got = {}
    for r in dom.select(dom.elements(parsed), SELECTORS).collect():
        got.setdefault((r.selector, keys[r.page]), []).append(r.pre)
    for key, html in pages.items():
        _, elements = dom.tree(html)
        for number, selector in enumerate(SELECTORS):
            want = [e["pre"] for e in elements if any(walk(elements, chain, e) for chain in dom.compounds_of(selector))]
            assert sorted(got.get((number, key), [])) == want, (selector, key)


def test_implied_ends_and_texts():
    text, elements = dom.tree("<p>a <b>bold<p>b &amp; c<ul><li>one<li>two <i>x</i></ul><table><tr><td>1<td>2<tr><td>3</table><select><option>o<option>q</select>")
    said = lambda e: text[e["start"] : e["start"] + e["length"]].strip()
    by = lambda tag: [said(e) for e in elements if e["tag"] == tag]
    assert by("p") == ["a bold", "b & c"] and by("li") == ["one", "two x"] and by("td") == ["1", "2", "3"] and by("tr") == ["1 2", "3"] and by("option") == ["o", "q"]
    assert all(e["last"] >= e["pre"] and (e["parent"] < 0 or elements[e["parent"]]["last"] >= e["last"]) for e in elements)


def test_long_broken_pages_are_read_in_linear_time():
    import time

    start = time.time()
    for html in ("<div>" * 100_000 + "</span>" * 100_000, "<p>" * 200_000, "<li>" * 100_000, "<b>x" * 100_000):
        dom.tree(html)
    assert time.time() - start < 30


def test_selectors_that_are_none():
    for bad in ("", "> a", "a >", "a,,b", "a:hover", "[", ".", "a,"):
        with pytest.raises(ValueError):
            dom.compounds_of(bad)


def parsed(spark, *htmls):
    return dom.parsed(spark.createDataFrame([(i, "https://s.test/a/b", h) for i, h in enumerate(htmls)], "key int, url string, html string"), "key", "url")


def test_precedence_of_patterns(spark):
    pages = parsed(
        spark,
        '<body class="pdp"><span class="price">$10</span><i data-amount="junk"></i><i data-amount="1.234,50"></i><i data-price="7"></i></body>',
        '<body id="cart-page"><main id="login-page">Now $1,299.00 or $5, in stock</main><p aria-label="4 stars"></p><p aria-label="8/10 rating"></p>',
        '<body><b itemprop="price" content="x">$12</b><b itemprop="ratingValue">80</b><i class="x SOLDOUT in-stock"></i><b itemprop="availability">In Stock</b><u class="num-reviews">1,204 reviews</u>',
        None, "<p>unavailable", '<div class="available"><p itemprop="availability" href="https://schema.org/PreOrder">',
    )
    got = {r.key: r for r in selectors.patterns(pages, "key").collect()}
    assert len(got) == 6
    assert (got[0].price, got[0].price_confidence, got[0].page_type, got[0].page_type_confidence) == (7.0, 0.95, 4, 0.90)
    assert (got[1].price, got[1].price_confidence, got[1].currency, got[1].rating, got[1].rating_confidence, got[1].page_type, got[1].page_type_confidence, got[1].availability, got[1].availability_confidence) == (1299.0, 0.70, "USD", 0.8, 0.90, 8, 0.85, 1.0, 0.80)
    assert (got[2].price, got[2].rating, got[2].rating_confidence, got[2].availability, got[2].availability_confidence, got[2].review_count) == (12.0, 0.8, 0.95, 1.0, 0.95, 1204)
    assert got[3].price is None and got[3].availability is None and got[4].availability == 0.0
    assert (got[5].availability, got[5].availability_confidence) == (0.5, 0.95)


def test_fields_belong_to_the_form_around_them(spark):
    pages = parsed(spark, '<input name="out"><form action="/x?y" method="post"><div><input name="a"><select name="b"></select></div><input></form><textarea name="z"></textarea><form><textarea name="c"></textarea></form>')
    got = [(r.action, r.method, [tuple(f) for f in r.fields]) for r in selectors.forms(pages).orderBy("pre").collect()]
    assert got == [("https://s.test/x?y", "POST", [("a", "input"), ("b", "select")]), ("https://s.test/a/b", "GET", [("c", "textarea")])]


def test_drag_precedence(spark):
    js = "<script>x = {handleDrop: function(e) { if (a) { b() } $.ajax({type: 'POST', url: '/mv'}) }} fetch('/other')</script>"
    pages = parsed(
        spark, '<div class="ui-sortable sortable"><p data-row-id="4"></p></div>' + js, '<p draggable="true"></p><script>import "@dnd-kit/core"</script>', '<p draggable="true"></p>', "<p>",
        '<link rel="canonical" href="https://team.notion.so/x"><div data-block-id="1"><div data-block-id="2"></div></div>', '<base href="https://nottrello.com/">',
    )
    got = {r.page: r for r in selectors.drag_actions(pages).collect()}
    keys = {r.page: r.key for r in pages.collect()}
    got = {keys[p]: r for p, r in got.items()}
    assert sorted(got) == [0, 1, 2, 4]
    assert (got[0].library, got[0].thing_id, got[0].method, got[0].endpoint, round(got[0].confidence, 2), got[0].things, got[0].places) == ("jquery-ui", "data-row-id", "POST", "/mv", 0.85, 1, 1)
    assert (got[1].library, got[1].things, got[1].endpoint, round(got[1].confidence, 2)) == ("dnd-kit", 0, None, 0.5)
    assert (got[2].library, round(got[2].confidence, 2)) == ("html5", 0.35)
    assert (got[4].platform, got[4].method, got[4].things, got[4].confidence) == ("notion.so", "POST", 2, 0.95)
    more = spark.createDataFrame([(p, "new Sortable(x)") for p, k in keys.items() if k == 3], "page long, code string")
    assert {keys[r.page]: r.library for r in selectors.drag_actions(pages, more).collect()}[3] == "sortablejs"


def test_selectors_within_a_page_move_no_element(spark):
    pages = parsed(
        spark, '<ul class="a b"><li id="x" data-k="v w">1</li><li>2<b class="b"></b></li></ul><p lang="en-us" title="xyz"></p><p></p>', "<p>", "", '<div class="a"><div class="a"><b></b></div></div><b class="b"></b>',
    )
    asked = ["*", "li", "#x", ".a.b", "ul > li", ".a > *", "li + li", ".a > .a > b, .b", "p + p, [data-k~='w']", "[lang|=en]", "[title^=x], [title$=z], [title*=y]", "[data-k=v]", "li + li > .b, li"]
    got = pages.select("page", *[F.transform(dom.within(F.col("elements"), s), lambda e: e["pre"]).alias(f"s{i}") for i, s in enumerate(asked)]).collect()
    found = {(i, r.page, n) for r in got for i in range(len(asked)) for n in r[f"s{i}"]}
    assert found == {(r.selector, r.page, r.pre) for r in dom.select(dom.elements(pages), asked).collect()} and len({i for i, _, _ in found}) == len(asked) - 1
    with pytest.raises(ValueError, match="needs select"):
        dom.within(F.col("elements"), "a b")
    plan = selectors.drag_actions(pages, None, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_only_closed_references_on_demand(spark):
    pages = spark.createDataFrame([("<a title='&amp;&lt'>x&amp;&amp;&amp</a><script>a&&b&lt</script>",)], "html string")
    got = []
    for bare in (True, False):
        page = dom.parsed(pages, bare=bare)
        got += [(r.said, r.attrs.get("title")) for r in dom.with_text(dom.select(dom.elements(page), ["a"]), page).collect()]
    assert got == [("x&&&", "&<"), ("x&&&amp", "&&lt")]
    assert dom.closed("<style>a&b</style>&#x27 &amp; & &nbsp") == "<style>a&b</style>&amp;#x27 &amp; & &amp;nbsp" and dom.closed(None) is None


def test_pages_are_neither_broadcast_nor_dealt_by_hook(spark):
    pages = dom.parsed(spark.range(50).selectExpr("concat('<p>', id, '</p>') AS html"))
    found = dom.select(dom.elements(pages), ["p", ".x"])
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    said = dom.with_text(found, pages)
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") and plan.count("BroadcastExchange") <= 2 and said.count() == 50


def test_chains_are_dealt_by_count_once_and_never_joined(spark):
    pages = dom.parsed(spark.range(30).selectExpr("concat('<div><p>', id, '</p><p class=\"a\">x</p></div>') AS html"))
    plan = dom.select(dom.elements(pages), ["div p", "div > p", "p + .a", "p ~ .a", "div, .a"])._jdf.queryExecution().executedPlan().toString()
    # no part is left to be joined to others by its compressed bytes
    assert "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert (dom.tasks_for(pages, 7), dom.tasks_for(pages), dom.tasks_for(pages.limit(0))) == (5, 1, 1)


def test_fetched_pages_of_sites_are_dealt_to_all_tasks(spark):
    from meshquery import map_queries

    assert "REPARTITION_BY_NUM" in map_queries._fetched(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_pages_meet_by_count(spark):
    pages = dom.parsed(spark.range(30).selectExpr("concat('<p>', id, '</p>') AS html"))
    said = dom.with_text(dom.select(dom.elements(pages), ["p"]), pages)
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "").split("SortMergeJoin")[0]
    by_page = dom.dealer(pages, 7)
    assert "hashpartitioning(page#" in (plan := by_page(pages)._jdf.queryExecution().executedPlan().toString()) and ", 5), REPARTITION_BY_NUM" in plan


def test_boards_are_dealt_to_all_tasks(spark):
    from meshquery import page_queries

    assert "REPARTITION_BY_NUM" in page_queries._boards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
