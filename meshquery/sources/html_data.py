"""Structured data of HTML pages: JSON-LD, OpenGraph, meta, microdata, links, headings, forms, price and rating patterns, script
URLs, embedded API calls. One pass of the standard library's parser per page in Arrow batches; everything after it is
column expressions."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DIM, FEATURE_DIM, NODE_FLAGS, PAGE_TYPE
from ..functions import text, urls

SCHEMA = (
    "url string, title string, lang string, has_jsonld boolean, has_opengraph boolean, has_microdata boolean, schema_type string, "
    "products array<struct<name:string,price:double,currency:string,original_price:double,availability:string,rating:double,rating_best:double,reviews:long>>, "
    "articles array<struct<headline:string,author:string,published:string>>, breadcrumbs array<struct<position:int,name:string,url:string>>, og map<string,string>, meta map<string,string>, "
    "links array<struct<url:string,text:string,internal:boolean,nofollow:boolean>>, headings array<struct<level:int,text:string>>, "
    "forms array<struct<action:string,method:string,fields:array<struct<name:string,type:string,required:boolean>>>>, labels array<struct<label:string,element:string>>, classes string, "
    "pattern struct<price:double,price_confidence:double,rating:double,rating_confidence:double,availability:double,availability_confidence:double>, scripts array<string>, script_text string"
)
# Attributes and class names that hold a price, a rating, availability, and how sure each source is.
PRICE_DATA = ("data-price", "data-amount", "data-product-price", "data-value", "data-price-value")
PRICE_CLASSES = ("price", "product-price", "offer-price", "current-price", "price-current", "sale-price", "price__current", "buying-price", "Price-amount", "a-price-whole")
RATING_DATA = ("data-rating", "data-score", "data-stars", "data-average-rating")
RATING_CLASSES = ("star-rating", "review-score", "rating", "customer-rating", "review-stars", "c-ratings", "product-rating")
IN_STOCK_CLASSES = ("in-stock", "instock", "available", "add-to-cart-btn", "fulfillment-add-to-cart")
OUT_CLASSES = ("out-of-stock", "outofstock", "unavailable", "sold-out", "soldout", "not-available")
PRICE_SURE, RATING_SURE, STOCK_SURE = (0.95, 0.95, 0.85, 0.70), (0.95, 0.95, 0.90, 0.85), (0.95, 0.90, 0.80)
# Page types of vocabulary types.
LD_PAGES = {
    "product": "product_detail", "article": "article", "newsarticle": "article", "blogposting": "article", "faqpage": "faq", "aboutpage": "about_page", "contactpage": "contact_page",
    "collectionpage": "search_results", "searchresultspage": "search_results", "itemlist": "product_listing", "offerlist": "product_listing", "checkoutpage": "checkout", "profilepage": "account",
    "mediagallery": "media_page", "imageobject": "media_page", "videoobject": "media_page", "discussionforumposting": "forum", "review": "review_list",
}
MONEY = re.compile(r"[$€£¥]\s?(\d[\d.,]*)")
STARS = re.compile(r"(\d(?:\.\d)?)\s*(?:out of|/)\s*5")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _number(value) -> float | None:
    found = re.search(r"\d[\d.,]*", str(value)) if value is not None else None
    if not found:
        return None
    raw = found[0].rstrip(".,")
    if re.search(r",\d{1,2}$", raw):
        raw = raw.replace(".", "").replace(",", ".")
    try:
        return float(raw.replace(",", ""))
    except ValueError:
        return None


def _first(value):
    return value[0] if isinstance(value, list) and value else value if not isinstance(value, list) else None


def _plain(value) -> str | None:
    value = _first(value)
    if isinstance(value, dict):
        value = value.get("name") or value.get("@id")
    return None if value is None else str(value)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.title, self.lang, self.ld, self.og, self.meta = "", None, [], {}, {}
        self.links, self.headings, self.forms, self.labels, self.scripts, self.code = [], [], [], [], [], []
        self.props, self.classes, self.seen = {}, [], {}
        self.itemtype, self.catch, self.buffer = None, [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        if tag == "html":
            self.lang = a.get("lang") or None
        if tag in ("html", "body", "main", "div", "section") and (names or a.get("id")):
            self.classes += [*names, a.get("id", "")]
        if tag == "meta":
            name, value = a.get("property") or a.get("name", ""), a.get("content", "")
            if name.startswith(("og:", "product:")):
                self.og.setdefault(name, value)
            elif name:
                self.meta.setdefault(name.lower(), value)
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.meta.setdefault("canonical", a.get("href", ""))
        elif tag == "form":
            self.forms.append({"action": a.get("action", ""), "method": a.get("method", "get").upper(), "fields": []})
        elif tag in ("input", "select", "textarea"):
            kind = a.get("type", "text").lower() if tag == "input" else tag
            if kind in ("submit", "button", "image"):
                self.labels.append((a.get("value", ""), kind))
            elif self.forms and a.get("name"):
                self.forms[-1]["fields"].append({"name": a["name"], "type": kind, "required": "required" in a})
        if a.get("itemtype"):
            self.itemtype = self.itemtype or a["itemtype"].rsplit("/", 1)[-1]
        if a.get("itemprop") and ("content" in a or "href" in a):
            self.props.setdefault(a["itemprop"], a.get("content") or a.get("href"))
        for kind, found in (("price_data", PRICE_DATA), ("rating_data", RATING_DATA)):
            for name in found:
                if a.get(name):
                    self.seen.setdefault(kind, a[name])
        if any(n in OUT_CLASSES for n in names):
            self.seen.setdefault("stock_class", 0.0)
        elif any(n in IN_STOCK_CLASSES for n in names):
            self.seen.setdefault("stock_class", 1.0)
        if tag == "script" and a.get("src"):
            self.scripts.append(a["src"])
        want = []
        if tag in ("title", "a", "button", "script") or re.fullmatch("h[1-6]", tag):
            want.append(tag)
        if a.get("itemprop") and "content" not in a:
            want.append(f"prop {a['itemprop']}")
        if any(n in PRICE_CLASSES for n in names) or a.get("id") == "priceblock_ourprice":
            want.append("price_class")
        if any(n in RATING_CLASSES for n in names):
            want.append("rating_class")
        if tag not in VOID:
            self.stack.append((tag, a))
            for w in want:
                self.catch.append((len(self.stack), w, a, len(self.buffer)))

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]
            self._close(at)

    def _close(self, depth: int) -> None:
        for d, w, a, start in [c for c in self.catch if c[0] > depth]:
            raw = "".join(self.buffer[start:])
            said = " ".join(raw.split())
            if w == "title":
                self.title = self.title or said
            elif w == "a" and a.get("href"):
                self.links.append((a["href"], said, "nofollow" in a.get("rel", "")))
                self.labels.append((said, "a"))
            elif w == "button":
                self.labels.append((said, a.get("type", "button") or "button"))
            elif w == "script":
                if "ld+json" in a.get("type", ""):
                    try:
                        self.ld.append(json.loads(raw))
                    except ValueError:
                        pass
                elif not a.get("src"):
                    self.code.append(raw)
            elif w[0] == "h" and w[1:].isdigit():
                self.headings.append((int(w[1:]), said))
            elif w.startswith("prop "):
                self.props.setdefault(w[5:], said)
            else:
                self.seen.setdefault(w, said)
        self.catch = [c for c in self.catch if c[0] <= depth]


def _things(ld) -> list[dict]:
    if isinstance(ld, list):
        return [t for x in ld for t in _things(x)]
    return [ld, *_things(ld.get("@graph", []))] if isinstance(ld, dict) else []


def read_page(url: str | None, html: str | None) -> dict:
    """One page's structured data as SCHEMA has it."""
    r = _Reader()
    try:
        r.feed(html or "")
        r._close(-1)
    except (AssertionError, ValueError):
        pass
    base = url or ""
    home = re.sub(r"^www\.", "", (urlsplit(base).hostname or "") if "://" in base else "")
    things = [t for x in r.ld for t in _things(x)]
    kind = lambda t: str(_first(t.get("@type")) or "")
    products, articles, crumbs = [], [], []
    for t in things:
        if kind(t) == "Product":
            offer = _first(t.get("offers")) or {}
            offer = offer if isinstance(offer, dict) else {}
            score = t.get("aggregateRating") or {}
            products.append({"name": _plain(t.get("name")), "price": _number(offer.get("price", offer.get("lowPrice"))), "currency": offer.get("priceCurrency"), "original_price": _number(offer.get("highPrice")), "availability": (str(offer["availability"]).rsplit("/", 1)[-1] if offer.get("availability") else None), "rating": _number(score.get("ratingValue")), "rating_best": _number(score.get("bestRating")), "reviews": int(_number(score.get("reviewCount", score.get("ratingCount"))) or 0) or None})
        elif kind(t) in ("Article", "NewsArticle", "BlogPosting"):
            articles.append({"headline": _plain(t.get("headline")), "author": _plain(t.get("author")), "published": _plain(t.get("datePublished"))})
        elif kind(t) == "BreadcrumbList":
            for i, e in enumerate(t.get("itemListElement") or [], 1):
                item = e.get("item") if isinstance(e, dict) else None
                crumbs.append({"position": int(e.get("position", i)) if isinstance(e, dict) else i, "name": _plain(e.get("name")) or _plain(item), "url": item.get("@id") if isinstance(item, dict) else item})
    micro = r.itemtype is not None
    if micro and not products and r.itemtype == "Product":
        products.append({"name": r.props.get("name"), "price": _number(r.props.get("price")), "currency": r.props.get("priceCurrency"), "original_price": None, "availability": (r.props.get("availability") or "").rsplit("/", 1)[-1] or None, "rating": _number(r.props.get("ratingValue")), "rating_best": _number(r.props.get("bestRating")), "reviews": int(_number(r.props.get("reviewCount")) or 0) or None})
    links = []
    for href, said, nofollow in r.links:
        try:
            full = urljoin(base, href)
            host = re.sub(r"^www\.", "", urlsplit(full).hostname or "")
        except ValueError:
            continue
        links.append({"url": full, "text": said, "internal": host == home, "nofollow": nofollow})
    flat = " ".join(" ".join(r.buffer).split())
    tiers = lambda found, sure: next(((v, c) for v, c in zip(found, sure, strict=True) if v is not None), (None, None))
    money, stars = MONEY.search(flat), STARS.search(flat)
    price = tiers((_number(r.seen.get("price_data")), _number(r.props.get("price")), _number(r.seen.get("price_class")), _number(money[1]) if money else None), PRICE_SURE)
    rating = tiers((_number(r.seen.get("rating_data")), _number(r.props.get("ratingValue")), _number(r.seen.get("rating_class")), float(stars[1]) if stars else None), RATING_SURE)
    low = flat.lower()
    said = 0.0 if any(w in low for w in text.OUT_OF_STOCK) else 1.0 if "in stock" in low else None
    prop = r.props.get("availability")
    stock = tiers((None if prop is None else 1.0 if "InStock" in prop else 0.0 if "OutOfStock" in prop else 0.5, r.seen.get("stock_class"), said), STOCK_SURE)
    top = next((kind(t) for t in things if kind(t).lower() in LD_PAGES), None) or (r.itemtype if micro else None)
    return {
        "url": url, "title": r.title or None, "lang": r.lang, "has_jsonld": bool(r.ld), "has_opengraph": bool(r.og), "has_microdata": micro, "schema_type": top, "products": products, "articles": articles,
        "breadcrumbs": crumbs, "og": r.og, "meta": r.meta, "links": links, "headings": [{"level": a, "text": b} for a, b in r.headings], "forms": r.forms, "labels": [{"label": a, "element": b} for a, b in r.labels],
        "classes": " ".join(r.classes), "pattern": {"price": price[0], "price_confidence": price[1], "rating": rating[0], "rating_confidence": rating[1], "availability": stock[0], "availability_confidence": stock[1]}, "scripts": r.scripts, "script_text": "\n".join(r.code),
    }


def structured(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """SCHEMA for every (url, html), with the columns named in ``keep`` beside."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = [pages.schema[k] for k in keep]
    full = StructType([*own, *StructType.fromDDL(SCHEMA).fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for x in batch.slice(at, 200).to_pylist():
                    page = read_page(x["url"], x["html"])
                    page["og"], page["meta"] = list(page["og"].items()), list(page["meta"].items())
                    out.append({**{k: x[k] for k in keep}, **page})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.select(*keep, *[c for c in ("url", "html") if c not in keep]).mapInArrow(run, full)


def marked(data: DataFrame) -> DataFrame:
    """Rows of ``structured`` of whose price, rating and stock only what markup tells is kept, not what free text seems to say (``$$$ 114``)."""
    tiers = (("price", PRICE_SURE), ("rating", RATING_SURE), ("availability", STOCK_SURE))
    told = [F.when(F.col(f"pattern.{c}_confidence") > sure[-1], F.col(f"pattern.{c}")) for c, sure in tiers]
    sure = [F.when(t.isNotNull(), F.col(f"pattern.{c}_confidence")) for t, (c, _) in zip(told, tiers, strict=True)]
    return data.withColumn("pattern", F.struct(*[x for t, s, (c, _) in zip(told, sure, tiers, strict=True) for x in (t.alias(c), s.alias(f"{c}_confidence"))]))


def completeness() -> Column:
    """How much of a page is known, 0 to 1."""
    has = lambda c: F.when(F.size(c) > 0, 1).otherwise(0)
    described = F.coalesce(F.try_element_at("meta", F.lit("description")), F.try_element_at("og", F.lit("og:description"))).isNotNull()
    return (2 * F.when(F.col("schema_type").isNotNull(), 1).otherwise(0) + has("headings") + has("links") + 2 * has("products") + has("breadcrumbs") + F.when(described, 1).otherwise(0) + F.when(F.col("has_opengraph") | F.col("has_microdata"), 1).otherwise(0) + has("forms")) / 10.0


def with_page_type(data: DataFrame) -> DataFrame:
    """Adds ``kind``, struct(page_type, confidence): the vocabulary type, else what page and URL agree on, else the surer one.
    In stages, so that each long chain of patterns is evaluated once."""
    types = F.create_map(*[F.lit(x) for k, v in LD_PAGES.items() for x in (k, PAGE_TYPE[v])])
    staged = data.withColumn("_told", F.try_element_at(types, F.lower("schema_type"))).withColumn("_url", urls.classify(F.col("url"))).withColumn("_class", text.page_type_in(F.col("classes")))
    both = lambda t, c: F.struct(t.cast("int").alias("page_type"), c.cast("double").alias("confidence"))
    told, by_class, by_url, sure = F.col("_told"), F.col("_class"), F.col("_url.page_type"), F.col("_url.confidence")
    kind = (
        F.when(told.isNotNull(), both(told, F.lit(0.95)))
        .when(by_class == by_url, both(by_class, (F.lit(0.85) + sure) / 2 + 0.1))
        .when(by_class.isNotNull() & (sure < 0.85), both(by_class, F.lit(0.85)))
        .otherwise(both(by_url, sure))
    )
    return staged.withColumn("kind", kind).drop("_told", "_url", "_class")


def features(meta: bool = False) -> Column:
    """The 128 features of a page with its kind as array<float>; 0 where unknown. With ``meta`` also what its meta tags tell: whether it
    may be indexed, and that it has a picture."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    p = F.get("products", F.lit(0))
    kind = F.col("kind")
    price = F.coalesce(p["price"], F.try_element_at("og", F.lit("product:price:amount")).try_cast("double"), F.col("pattern.price"))
    described = F.coalesce(F.length(F.coalesce(F.try_element_at("meta", F.lit("description")), F.try_element_at("og", F.lit("og:description")))), F.lit(0))
    inside = F.size(F.filter("links", lambda x: x["internal"]))
    scale = text.rating_scale(F.col("pattern.rating"))
    stock = F.when(p["availability"].contains("InStock"), 1.0).when(p["availability"].contains("OutOfStock"), 0.0).when(p["availability"].isNotNull(), 0.5)
    n_fields = F.aggregate("forms", F.lit(0), lambda a, f: a + F.size(f["fields"]))
    secure = F.when(F.col("url").startswith("https://"), 1.0).otherwise(0.0)
    known = {
        "page_type": kind["page_type"] / 31.0, "page_type_confidence": kind["confidence"], "content_language": F.when(F.col("lang").isNotNull(), 1.0), "is_https": secure,
        "url_path_depth": urls.path_depth(F.col("url")) / 10.0, "url_has_query": F.when(F.col("url").contains("?"), 1.0), "url_has_fragment": F.when(F.col("url").contains("#"), 1.0),
        "has_structured_data": F.when(F.col("has_jsonld"), 1.0).when(F.col("has_opengraph"), 0.5), "text_length_log": clamp(F.log1p(described.cast("double")) / 12), "heading_count": clamp(F.size("headings") / 10.0),
        "link_count_internal": clamp(inside / 100.0), "link_count_external": clamp((F.size("links") - inside) / 50.0), "form_field_count": clamp(n_fields / 20.0), "price": price, "price_original": p["original_price"],
        "discount_pct": F.when(p["original_price"] > 0, clamp(1 - price / p["original_price"])), "availability": F.coalesce(stock, F.col("pattern.availability")),
        "rating": clamp(F.coalesce(p["rating"] / F.coalesce(p["rating_best"], F.lit(5.0)), F.col("pattern.rating") / scale)), "review_count_log": clamp(F.log1p(p["reviews"].cast("double")) / 10),
        "outbound_links": clamp(F.size("links") / 100.0), "breadcrumb_depth": clamp(F.size("breadcrumbs") / 5.0), "is_dead_end": F.when(F.size("links") == 0, 1.0), "tls_valid": secure, "content_freshness": F.lit(1.0),
        "action_count": clamp(F.size("forms") / 20.0),
    }
    if meta:
        noindex = F.contains(F.try_element_at("meta", F.lit("robots")), F.lit("noindex"))
        known |= {"meta_robots_index": F.when(F.coalesce(noindex, F.lit(False)), 0.0).otherwise(1.0), "image_count": F.when(F.try_element_at("og", F.lit("og:image")).isNotNull(), 0.1)}
    at = {DIM[k]: v for k, v in known.items()}
    return F.array(*[F.coalesce(at[i].cast("float"), F.lit(0.0).cast("float")) if i in at else F.lit(0.0).cast("float") for i in range(FEATURE_DIM)])


def flags() -> Column:
    """Node flags told by a page's data."""
    bit = lambda name, cond: F.when(cond, F.lit(NODE_FLAGS[name])).otherwise(F.lit(0))
    priced = F.coalesce(F.get("products", F.lit(0))["price"], F.col("pattern.price")).isNotNull()
    return bit("has_form", F.size("forms") > 0).bitwiseOR(bit("has_price", priced)).bitwiseOR(bit("has_media", F.try_element_at("og", F.lit("og:image")).isNotNull())).bitwiseOR(F.lit(NODE_FLAGS["rendered"]))


def nodes(data: DataFrame, meta: bool = False) -> DataFrame:
    """Pages as graph nodes: (domain, url, page_type, confidence, flags, features, completeness); ``meta`` as for ``features``."""
    kind = F.col("kind")
    return with_page_type(data).select(urls.site(F.col("url")).alias("domain"), "url", kind["page_type"].alias("page_type"), F.round(F.least(kind["confidence"], F.lit(1.0)) * 255).cast("int").alias("confidence"), flags().alias("flags"), features(meta).alias("features"), completeness().alias("completeness"))


def page_actions(data: DataFrame) -> DataFrame:
    """(url, label, element, category, action) of buttons, links and forms."""
    said = data.select("url", F.explode("labels").alias("l")).select("url", "l.label", "l.element")
    forms = data.select("url", F.explode("forms").alias("f")).select("url", F.col("f.action").alias("label"), F.lit("submit").alias("element"))
    every = said.unionByName(forms).withColumn("code", text.action_code(F.col("label"), F.col("element")))
    return every.select("url", "label", "element", "code.category", "code.action")


# Calls in scripts that tell an endpoint, and how sure each is.
CALLS = (
    (r"fetch\(\s*['\"]([^'\"]+)['\"]", 0.80), (r"axios\.(?:get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", 0.80), (r"\$\.(?:ajax|get|post|getJSON)\(\s*['\"]([^'\"]+)['\"]", 0.75),
    (r"\.open\(\s*['\"][A-Z]+['\"]\s*,\s*['\"]([^'\"]+)['\"]", 0.70), (r"['\"](/api/[^'\"\s]+)['\"]", 0.55),
)


def api_calls(data: DataFrame) -> DataFrame:
    """(url, endpoint, confidence) of calls in inline scripts; the surest source of each endpoint."""
    found = F.concat(*[F.transform(F.regexp_extract_all("script_text", F.lit(p), F.lit(1)), _with(c)) for p, c in CALLS])
    return data.select("url", F.explode(found).alias("x")).groupBy("url", F.col("x.e").alias("endpoint")).agg(F.max("x.c").alias("confidence"))


def _with(confidence: float):
    return lambda e: F.struct(e.alias("e"), F.lit(confidence).alias("c"))


# Ways in which scripts name an endpoint, first wins: pattern, group of the address, group of the method (or the
# method itself), and how sure each is.
SCRIPT_ACTIONS = (
    (r"fetch\(\s*['\"]([^'\"]+)['\"]\s*,\s*\{[^}]*method\s*:\s*['\"](\w+)['\"]", 1, 2, 0.80),
    (r"fetch\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, "GET", 0.70),
    (r"axios\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", 2, 1, 0.80),
    (r"\$\.ajax\(\s*\{([^}]*)\}", None, None, 0.75),
    (r"['\"](/api/[^'\"]+)['\"]", 1, "GET", 0.60),
    (r"['\"]([^'\"]*(?:/graphql|/gql)[^'\"]*)['\"]", 1, "POST", 0.75),
    (r"\.open\(\s*['\"](\w+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 2, 1, 0.70),
    (r"['\"]([^'\"]*?/v[0-9]+/[^'\"]+)['\"]", 1, "GET", 0.55),
)
AJAX_URL, AJAX_METHOD = r"url\s*:\s*['\"]([^'\"]+)['\"]", r"type\s*:\s*['\"](\w+)['\"]"


def script_actions(data: DataFrame) -> DataFrame:
    """(url, method, endpoint, confidence) of the calls that a page's scripts can make; the first way that names one counts."""
    def found(rank: int, pattern: str, address, method, sure: float) -> Column:
        every = lambda group: F.regexp_extract_all("script_text", F.lit(pattern), F.lit(group))
        one = lambda e, m: F.struct(F.upper(m).alias("method"), e.alias("endpoint"), F.lit(rank).alias("rank"), F.lit(sure).alias("confidence"))
        if address is None:  # an options block: address and method stand inside
            blocks = F.filter(every(1), lambda b: b.rlike(AJAX_URL))
            return F.transform(blocks, lambda b: one(F.regexp_extract(b, AJAX_URL, 1), F.coalesce(F.nullif(F.regexp_extract(b, AJAX_METHOD, 1), F.lit("")), F.lit("GET"))))
        if isinstance(method, str):
            return F.transform(every(address), lambda e: one(e, F.lit(method)))
        return F.zip_with(every(address), every(method), one)

    each = F.concat(*[found(rank, *way) for rank, way in enumerate(SCRIPT_ACTIONS)])
    rows = data.select("url", F.explode(each).alias("x")).select("url", "x.*").withColumn("endpoint", urls.resolve(F.col("url"), F.col("endpoint")))
    return first_source(rows, ["url", "method", "endpoint"], "rank").drop("rank")


def layered(rendered: DataFrame, static: DataFrame) -> DataFrame:
    """Pages built from two layers: static (url, features, flags, completeness) pages, each with the rendered (url, final_url,
    features, flags, completeness) page of its url or, without one, of its final_url. Features are merged one by one,
    flags are united, ``source`` says what a page was built from. Both joins are on an address."""
    from ..operators.vector import merged_features

    sides = rendered.select("url", F.coalesce("final_url", "url").alias("final_url"), F.struct("features", "flags", "completeness").alias("seen"))
    own = F.min(F.struct("final_url", "seen")).alias("m")
    by_url = sides.groupBy("url").agg(own).select("url", F.col("m.seen").alias("own"))
    by_final = sides.groupBy(F.col("final_url").alias("url")).agg(F.min(F.struct("url", "seen")).alias("m")).select("url", F.col("m.seen").alias("moved"))
    met = static.join(by_url, "url", "left").join(by_final, "url", "left").withColumn("seen", F.coalesce("own", "moved"))
    both = F.when(F.col("seen").isNull(), F.col("features")).otherwise(merged_features(F.col("seen.features"), F.col("features"), F.col("seen.completeness"), F.col("completeness")))
    mark = F.when(F.col("seen").isNull(), F.lit(NODE_FLAGS["estimated"])).otherwise(F.lit(NODE_FLAGS["rendered"]))
    return met.select("url", both.alias("features"), F.col("flags").bitwiseOR(F.coalesce("seen.flags", F.lit(0))).bitwiseOR(mark).alias("flags"), F.when(F.col("own").isNotNull(), "url").when(F.col("moved").isNotNull(), "final_url").otherwise("static").alias("source"))


def with_action_ratios(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Nodes (.., url, features) with the shares of safe (risk 0), cautious (1) and destructive (2 and more) actions of
    (url, risk) filled in, and their number in twentieths."""
    share = lambda hit: F.count_if(hit) / F.count("*")
    sums = actions.groupBy("url").agg(F.least(F.count("*") / 20.0, F.lit(1.0)).alias("n"), share(F.col("risk") == 0).alias("safe"), share(F.col("risk") == 1).alias("cautious"), share(F.col("risk") >= 2).alias("destructive"))
    places = {DIM["action_count"]: "n", DIM["safe_action_ratio"]: "safe", DIM["cautious_action_ratio"]: "cautious", DIM["destructive_action_ratio"]: "destructive"}
    values = F.create_map(*[x for i, c in places.items() for x in (F.lit(i), F.col(c).cast("float"))])
    filled = F.transform("features", lambda v, i: F.coalesce(F.try_element_at(values, i), v))
    joined = nodes.join(sums, "url", "left")
    return joined.withColumn("features", F.when(F.col("n").isNull(), F.col("features")).otherwise(filled)).select(*nodes.columns)


def sockets(data: DataFrame) -> DataFrame:
    """(url, endpoint, protocol) of web sockets in scripts."""
    raw = F.transform(F.regexp_extract_all("script_text", F.lit(r"['\"](wss?://[^'\"\s]+)['\"]"), F.lit(1)), lambda e: F.struct(e.alias("e"), F.lit("websocket").alias("p")))
    kinds = {"socket.io": r"\bio\(\s*['\"]([^'\"]*)['\"]", "sockjs": r"new SockJS\(\s*['\"]([^'\"]+)['\"]", "signalr": r"\.withUrl\(\s*['\"]([^'\"]+)['\"]"}
    more = [F.transform(F.regexp_extract_all("script_text", F.lit(p), F.lit(1)), _named(k)) for k, p in kinds.items()]
    return data.select("url", F.explode(F.concat(raw, *more)).alias("x")).select("url", F.col("x.e").alias("endpoint"), F.col("x.p").alias("protocol")).distinct()


def _named(kind: str):
    return lambda e: F.struct(e.alias("e"), F.lit(kind).alias("p"))


def packed_actions(pages: DataFrame, packs: DataFrame) -> DataFrame:
    """(url, platform, method, endpoint, confidence) of rule packs (platform, indicator, method, endpoint, confidence) whose
    indicator a page's source contains. Packs are the caller's few rows; Spark broadcasts them if they are as small as its
    threshold, and the surest rule of an endpoint wins."""
    met = pages.select("url", "html").join(packs, F.contains(F.col("html"), F.col("indicator")))
    return met.groupBy("url", "platform", "method", "endpoint").agg(F.max("confidence").alias("confidence"))


# Drag-and-drop libraries by a mark in a page's source.
DRAG = {"sortable": "sortablejs", "react-beautiful-dnd": "data-rbd-", "dnd-kit": "dnd-kit", "html5": 'draggable="true"', "jquery-ui": "ui-draggable", "angular-cdk": "cdkdrag"}


def drag_libraries(pages: DataFrame) -> DataFrame:
    """(url, library, items, zones): drag-and-drop libraries told by the source, with draggable items and drop zones counted."""
    low = F.lower(F.coalesce("html", F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.contains(mark.lower()), F.lit(name)) for name, mark in DRAG.items()]))
    items = F.regexp_count(low, F.lit(r'draggable\s*=\s*"true"|data-rbd-draggable-id|cdkdrag[\s>]'))
    zones = F.regexp_count(low, F.lit(r"data-rbd-droppable-id|cdkdroplist|ondrop\s*=|dropzone"))
    return pages.select("url", F.explode(found).alias("library"), items.alias("items"), zones.alias("zones"))


def first_source(rows: DataFrame, key: list[str], rank: str) -> DataFrame:
    """One row per key: that of the first source (lowest rank)."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def page_urls(data: DataFrame) -> DataFrame:
    """(url, found, source) of the addresses in a page: links, canonical, script state; the first source of each."""
    links = data.select("url", F.explode("links.url").alias("found"), F.lit(0).alias("rank"), F.lit("link").alias("source"))
    canonical = data.select("url", F.try_element_at("meta", F.lit("canonical")).alias("found"), F.lit(1).alias("rank"), F.lit("canonical").alias("source")).where("found is not null")
    state = data.select("url", F.explode(F.regexp_extract_all("script_text", F.lit(r"['\"](https?://[^'\"\s<>]+)['\"]"), F.lit(1))).alias("found"), F.lit(2).alias("rank"), F.lit("script").alias("source"))
    return first_source(links.unionByName(canonical).unionByName(state), ["url", "found"], "rank").drop("rank")
