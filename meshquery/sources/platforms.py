"""Packs of known platforms: shop systems told by marks in a page, with the requests they take; sites that talk over web sockets, with address,
protocol and authentication; forms as requests. Marks of all packs are found by one automaton in one pass over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import multipattern, text, urls
from . import dom as tree

# Marks of platforms in a page's source, the most specific platform first.
MARKS = (
    ("shopify", ("Shopify.", "Shopify.shop", "/cdn.shopify.com/", "shopify-section")), ("woocommerce", ("wc_add_to_cart_params", "woocommerce", "/wp-content/plugins/woocommerce")),
    ("magento", ("Magento_", "requirejs-config", "mage/", "Magento_Ui", "Magento_Catalog")), ("bigcommerce", ("BigCommerce", "bigcommerce", "data-product-id")),
    ("squarespace", ("Squarespace.", "Static.SQUARESPACE", "squarespace.com", "sqs-block", "sqsp")), ("wix", ("wixcode-sdk", "wix-", "Wix.", "static.wixstatic.com", "wix-dropdown", "_wix_browser_sess")),
    ("prestashop", ("prestashop", "PrestaShop", "/modules/ps_")), ("opencart", ("route=checkout/cart", "getURLVar", "route=common/home", "index.php?route=")),
    ("nextjs_commerce", ("__NEXT_DATA__", "_next/static", "__next")), ("drupal", ("Drupal.", "drupalSettings", "/sites/default/files", "drupal.org")),
    ("wordpress", ("wp-includes", "wp.customize", "/wp-content/", "/wp-includes/", "wp-json")),
)
# What the platforms do on request: label, (category, action), kind, method, address, and how sure it is.
REQUESTS = (
    ("shopify", "Add to Cart", 2, 0, "add_to_cart", "POST", "/cart/add.js", 0.90), ("shopify", "Update Cart", 2, 2, "update_cart", "POST", "/cart/update.js", 0.85),
    ("shopify", "Remove from Cart", 2, 1, "remove_from_cart", "POST", "/cart/change.js", 0.85), ("shopify", "Get Cart", 2, 6, "get_cart", "GET", "/cart.js", 0.90),
    ("woocommerce", "Add to Cart", 2, 0, "add_to_cart", "POST", "/?wc-ajax=add_to_cart", 0.85), ("woocommerce", "View Cart", 2, 6, "view_cart", "GET", "/cart/", 0.85),
    ("woocommerce", "Apply Coupon", 2, 3, "apply_coupon", "POST", "/?wc-ajax=apply_coupon", 0.80),
    ("magento", "Add to Cart", 2, 0, "add_to_cart", "POST", "/checkout/cart/add/", 0.85), ("magento", "Add to Wishlist", 2, 5, "add_to_wishlist", "POST", "/wishlist/index/add/", 0.80),
    ("magento", "Add to Compare", 2, 4, "add_to_compare", "POST", "/catalog/product_compare/add/", 0.80),
    ("bigcommerce", "Add to Cart", 2, 0, "add_to_cart", "POST", "/remote/v1/cart/add", 0.85), ("bigcommerce", "Get Cart", 2, 6, "get_cart", "GET", "/api/storefront/cart", 0.85),
    ("squarespace", "Add to Cart", 2, 0, "add_to_cart", "POST", "/api/commerce/shopping-cart/entries", 0.80), ("squarespace", "Get Cart", 2, 6, "get_cart", "GET", "/api/commerce/shopping-cart", 0.80),
    ("wix", "Add to Cart", 2, 0, "add_to_cart", "POST", "/_api/cart-server/v1/cart/current/addToCart", 0.80), ("wix", "Search", 1, 0, "search", "GET", "/_api/search-api/v1/search", 0.75),
    ("prestashop", "Add to Cart", 2, 0, "add_to_cart", "POST", "/cart?add=1", 0.80), ("opencart", "Add to Cart", 2, 0, "add_to_cart", "POST", "/index.php?route=checkout/cart/add", 0.80),
    ("nextjs_commerce", "Search", 1, 0, "search", "GET", "/api/search", 0.65), ("wordpress", "Search", 1, 0, "search", "GET", "/wp-json/wp/v2/search", 0.75),
    ("wordpress", "Submit Comment", 3, 0, "comment", "POST", "/wp-comments-post.php", 0.80), ("drupal", "Search", 1, 0, "search", "GET", "/search/node", 0.75),
)
# Sites that talk over web sockets: address (or its pattern), protocol, authentication.
SOCKETS = (
    ("slack.com", "wss://wss-primary.slack.com/", "raw", "query_param"), ("discord.com", "wss://gateway.discord.gg/?v=10&encoding=json", "raw", "first_message"),
    ("teams.microsoft.com", "wss://trouter2-{region}-signal.trouter.teams.microsoft.com/", "raw", "query_param"), ("web.whatsapp.com", "wss://web.whatsapp.com/ws/chat", "raw", "cookie"),
    ("linear.app", "wss://sync.linear.app/", "raw", "header"), ("firebase.google.com", "wss://{project}.firebaseio.com/.ws", "raw", "query_param"),
    ("supabase.co", "wss://{project}.supabase.co/realtime/v1/websocket", "raw", "query_param"), ("notion.so", "wss://msgstore.www.notion.so/primus/", "sockjs", "cookie"),
    ("figma.com", "wss://www.figma.com/fig-wss/", "raw", "cookie"), ("github.com", "wss://alive.github.com/", "raw", "cookie"), ("reddit.com", "wss://gql-realtime-2.reddit.com/query", "raw", "header"),
    ("x.com", "wss://streaming.x.com/", "raw", "header"), ("stripe.com", "wss://dashboard.stripe.com/ws/", "raw", "cookie"), ("vercel.com", "wss://ws.vercel.com/", "raw", "header"),
    ("gitlab.com", "wss://gitlab.com/-/cable", "raw", "cookie"), ("bloomberg.com", "wss://push.bloomberg.com/ws/", "raw", "header"),
    ("coinmarketcap.com", "wss://push.coinmarketcap.com/ws", "raw", "none"), ("finance.yahoo.com", "wss://streamer.finance.yahoo.com/", "raw", "none"),
)
# Calls that open a socket: pattern, protocol, authentication, how sure, and words one of which must be there too.
OPENERS = (
    (r"new\s+WebSocket\(\s*['\"](wss?://[^'\"]+)['\"]", "raw", "none", 0.90, ()), (r"io(?:\.connect)?\(\s*['\"]((?:wss?|https?)://[^'\"]+)['\"]", "socketio", "cookie", 0.85, ()),
    (r"new\s+SockJS\(\s*['\"]([^'\"]+)['\"]", "sockjs", "cookie", 0.85, ()), (r"\.withUrl\(\s*['\"]([^'\"]+)['\"]", "signalr", "cookie", 0.85, ("signalR", "HubConnection")),
)
# What a form does, by words of its label and parts of its address, first wins; otherwise it submits (4, 0).
FORM_WORDS = (
    (("add to cart", "add to bag"), ("/cart/add",), (2, 0)), (("search",), ("/search",), (0, 1)), (("log in", "login", "sign in"), ("/login", "/signin"), (4, 1)), (("subscribe", "newsletter"), (), (4, 3)),
    (("register", "sign up", "signup"), (), (4, 2)),
)
KNOWN_SURE, FORM_SURE = 0.95, 0.90


def platform_of(html: Column) -> Column:
    """Name of the first platform (in the order of MARKS) of which a source has a mark; null if none."""
    marks = [m for _, found in MARKS for m in found]
    names = [name for name, found in MARKS for _ in found]
    return F.get(multipattern.names_in(html, marks, names), F.lit(0))


def platform_requests(pages: DataFrame, *kept: str) -> DataFrame:
    """(kept.., platform, label, category, action, kind, method, endpoint, confidence) of pages (kept.., html) on a known platform."""
    packs = pages.sparkSession.createDataFrame([*REQUESTS], "platform string, label string, category int, action int, kind string, method string, endpoint string, confidence double")
    return pages.select(*kept, platform_of(F.col("html")).alias("platform")).where("platform IS NOT NULL").join(F.broadcast(packs), "platform").select(*kept, *packs.columns)


def socket_endpoints(pages: DataFrame, *kept: str, domain: str = "domain", html: str = "html") -> DataFrame:
    """(kept.., endpoint, protocol, auth, source, confidence) of pages (kept.., domain, html): the addresses of known sites (whose name is part of
    the domain, or has it as a part) first, then calls in the source; the first source of an address counts per row of ``kept``."""
    site = F.col(domain)
    named = F.array_union(multipattern.found_in(site, [s for s, *_ in SOCKETS]), F.array_compact(F.array(*[F.when(F.contains(F.lit(s), site), F.lit(i)) for i, (s, *_) in enumerate(SOCKETS)])))
    said = lambda raw, endpoint, protocol, auth, source, sure, rank: F.struct(raw.alias("raw"), endpoint.alias("endpoint"), F.lit(protocol).alias("protocol") if isinstance(protocol, str) else protocol.alias("protocol"), F.lit(auth).alias("auth") if isinstance(auth, str) else auth.alias("auth"), source.alias("source"), F.lit(sure).alias("confidence"), F.lit(rank).alias("rank"))
    row = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("site", "address", "protocol", "auth"), s, strict=True)]) for s in SOCKETS])
    known = F.when(site != "", F.transform(named, lambda i: _known(row, i, said)))
    calls = []
    for rank, (pattern, protocol, auth, sure, words) in enumerate(OPENERS, 1):
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
        if words:
            found = F.when(text._any(F.col(html), words), found)
        calls.append(F.transform(found, _call(protocol, auth, sure, rank, said)))
    none = F.array().cast("array<struct<raw:string,endpoint:string,protocol:string,auth:string,source:string,confidence:double,rank:int>>")
    every = F.concat(*[F.coalesce(c, none) for c in (known, *calls)])
    rows = pages.select(*kept, F.explode(every).alias("x")).select(*kept, "x.*")
    best = rows.groupBy(*kept, "raw").agg(F.min_by(F.struct("endpoint", "protocol", "auth", "source", "confidence"), "rank").alias("x"))
    return best.select(*kept, "x.*")


def _known(row: Column, i: Column, said) -> Column:
    s = F.get(row, i)
    return said(s["address"], s["address"], s["protocol"], s["auth"], F.concat(F.lit("platform:"), s["site"]), KNOWN_SURE, 0)


def _call(protocol: str, auth: str, sure: float, rank: int, said):
    def one(raw: Column) -> Column:
        endpoint = F.regexp_replace(F.replace(raw, F.lit("https://"), F.lit("wss://")), "http://", "ws://") if protocol == "socketio" else raw
        return said(raw, endpoint, protocol, auth, F.lit("html"), sure, rank)

    return one


def form_requests(dom: DataFrame, url: str = "url") -> DataFrame:
    """(page, label, category, action, method, endpoint, content_type, fields array<struct<name,type,value,required>>, confidence) of the forms of
    parsed pages. The label is the form's first button's."""
    found = tree.select(tree.elements(dom), ["form", "input, select, textarea", 'button, input[type="submit"]']).select("selector", "page", "pre", "last", "tag", "attrs", "start", "length")
    at = lambda n, c="attrs": F.try_element_at(F.col(c), F.lit(n))
    own = F.max(F.when(F.col("selector") == 0, F.struct("pre", "last"))).over(W.partitionBy("page").orderBy("pre").rangeBetween(W.unboundedPreceding, -1))
    inside = found.withColumn("form", own).where("selector > 0 AND form.last >= pre").withColumn("at", F.col("form.pre"))
    field = F.struct(at("name").alias("name"), F.coalesce(at("type"), F.col("tag")).alias("type"), at("value").alias("value"), at("required").isNotNull().alias("required"))
    fields = inside.where("selector = 1").where(at("name") != "").groupBy("page", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", field.alias("f")))), lambda x: x["f"]).alias("fields"))
    first = inside.where("selector = 2").groupBy("page", "at").agg(F.min_by(F.struct("attrs", "start", "length", "pre"), "pre").alias("b")).select("page", "at", "b.*")
    label = F.coalesce(at("value"), F.col("said"))
    buttons = tree.with_text(first, dom).select("page", "at", F.nullif(label, F.lit("")).alias("label"))
    base = dom.select("page", F.col(url).alias("base"))
    given = F.coalesce(at("action"), F.lit(""))
    forms = found.where("selector = 0").join(base, "page").select(
        "page", F.col("pre").alias("at"), F.when(given == "", F.col("base")).otherwise(urls.resolve(F.col("base"), given)).alias("endpoint"), F.upper(F.coalesce(at("method"), F.lit("GET"))).alias("method"),
        F.coalesce(at("enctype"), F.lit("application/x-www-form-urlencoded")).alias("content_type"),
    )
    joined = forms.join(buttons, ["page", "at"], "left").join(fields, ["page", "at"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Form → "), F.col("endpoint"))))
    low, address, code = F.lower("label"), F.lower("endpoint"), None
    for words, parts, (category, action) in FORM_WORDS:
        hit = text._any(low, words) | text._any(address, parts)
        does = F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"))
        code = F.when(hit, does) if code is None else code.when(hit, does)
    code = code.otherwise(F.struct(F.lit(4).alias("category"), F.lit(0).alias("action")))
    no_fields = F.array().cast("array<struct<name:string,type:string,value:string,required:boolean>>")
    return joined.withColumn("code", code).select("page", "label", "code.category", "code.action", "method", "endpoint", "content_type", F.coalesce("fields", no_fields).alias("fields"), F.lit(FORM_SURE).alias("confidence"))
