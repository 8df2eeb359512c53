"""What can be done on a site, from the action records of its pages: each (model, action) once, with the request that it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import PAGE_TYPE

# Name, model and whether it is of one instance, by (category, action); the model ``*`` is the page's own, or what stands
# after it; action -1 is any other of the category.
ACTIONS = (
    (0, 0, "click", "Site", False), (0, 1, "navigate", "Site", False), (0, 2, "scroll", "Site", False), (0, -1, "navigate", "Site", False),
    (1, 0, "submit_form", "Site", False), (1, 1, "search", "Site", False), (1, 2, "filter", "Site", False), (1, 3, "sort", "Site", False), (1, -1, "submit", "Site", False),
    (2, 0, "add_to_cart", "*Product", True), (2, 1, "remove_from_cart", "Cart", True), (2, 2, "update_quantity", "Cart", True), (2, 3, "apply_coupon", "Cart", False),
    (2, 4, "checkout", "Cart", False), (2, 5, "add_to_wishlist", "*Product", True), (2, -1, "cart_action", "Cart", False),
    (3, 0, "login", "Site", False), (3, 1, "logout", "Site", False), (3, 2, "register", "Site", False), (3, -1, "auth_action", "Site", False),
    (4, 0, "play", "Media", True), (4, 1, "pause", "Media", True), (4, 2, "download", "Media", True), (4, -1, "media_action", "Media", True),
    (5, 0, "like", "Site", True), (5, 1, "share", "Site", True), (5, 2, "comment", "Site", True), (5, 3, "follow", "Site", True), (5, -1, "social_action", "Site", True),
    (6, 0, "export", "Site", False), (6, 1, "import", "Site", False), (6, -1, "data_action", "Site", False),
)
# Requests of well-known actions: method, address, and parameters (name, type, required, default, where).
REQUESTS = (
    ("search", "GET", "/search?q={query}", (("query", "string", True, None, "url_param"),)),
    ("add_to_cart", "POST", "/cart/add", (("node_id", "integer", True, None, "json_body"), ("quantity", "integer", False, "1", "json_body"))),
    ("remove_from_cart", "POST", "/cart/remove", (("node_id", "integer", True, None, "json_body"),)), ("apply_coupon", "POST", "/cart/coupon", (("code", "string", True, None, "json_body"),)),
    ("checkout", "POST", "/checkout", (("payment_method", "string", False, "saved_card", "json_body"),)),
    ("login", "POST", "/auth/login", (("email", "string", True, None, "json_body"), ("password", "string", True, None, "json_body"))),
    ("filter", "GET", "/filter", (("criteria", "string", True, None, "url_param"),)), ("sort", "GET", "/sort", (("criteria", "string", True, None, "url_param"),)),
)
# Models of page types.
MODELS = {
    "product_detail": "Product", "product_listing": "ProductListing", "article": "Article", "review_list": "Review", "cart": "Cart", "checkout": "CheckoutPage",
    "account": "Account", "login": "LoginPage", "home": "WebSite", "search_results": "SearchResultsPage",
}
AUTH, READING = 3, (0, 1)
PARAMS = "array<struct<name:string,type:string,required:boolean,default:string,source:string>>"


def _map(pairs: list[tuple]) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (k if isinstance(k, Column) else F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def compiled(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(domain, model, name, is_instance, method, endpoint, params, requires_auth, path, confidence): every action of every site, told by its first
    record in the order of (node_id, place), of action records (domain, node_id, place, category, action, risk, http) on nodes (domain, node_id, page_type); and the
    search and cart views that a site's page types promise where no record gives them."""
    rule = F.struct
    rules = _map([(F.concat_ws("/", F.lit(c), F.lit(a)), rule(F.lit(name).alias("name"), F.lit(model).alias("model"), F.lit(one).alias("one"))) for c, a, name, model, one in ACTIONS])
    own = F.try_element_at(_map([(PAGE_TYPE[k], v) for k, v in MODELS.items()]), F.col("page_type"))
    told = F.coalesce(F.try_element_at(rules, F.concat_ws("/", "category", "action")), F.try_element_at(rules, F.concat_ws("/", "category", F.lit(-1))))
    named = actions.join(nodes.select("domain", "node_id", "page_type"), ["domain", "node_id"]).withColumn("_told", told).withColumn("_own", own)
    unknown = F.concat(F.lit("action_"), F.lpad(F.lower(F.hex("category")), 2, "0"), F.lit("_"), F.lpad(F.lower(F.hex("action")), 2, "0"))
    model = F.when(F.col("_told").isNull(), F.coalesce("_own", F.lit("Site"))).when(F.startswith("_told.model", F.lit("*")), F.coalesce("_own", F.substring("_told.model", 2, 100))).otherwise(F.col("_told.model"))
    each = named.select("domain", model.alias("model"), F.coalesce("_told.name", unknown).alias("name"), F.struct("node_id", "place").alias("at"), F.struct(F.coalesce("_told.one", F.lit(False)).alias("is_instance"), "category", "risk", "http").alias("x"))
    first = each.groupBy("domain", "model", "name").agg(F.min_by("x", "at").alias("x")).select("domain", "model", "name", "x.*")
    requests = _map([(n, F.struct(F.lit(m).alias("method"), F.lit(e).alias("endpoint"), F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, c, t in zip(p, ("name", "type", "required", "default", "source"), ("string", "string", "boolean", "string", "string"), strict=True)]) for p in params]).alias("params"))) for n, m, e, params in REQUESTS])
    known = F.try_element_at(requests, F.col("name"))
    plain = F.when(F.col("category").isin(*READING), "GET").otherwise("POST")
    columns = [
        "domain", "model", "name", "is_instance", F.coalesce(known["method"], plain).alias("method"), F.coalesce(known["endpoint"], F.concat(F.lit("/"), F.replace(F.col("name"), F.lit("_"), F.lit("-")))).alias("endpoint"),
        F.coalesce(known["params"], F.array().cast(PARAMS)).alias("params"), F.coalesce((F.col("risk") >= 1) | (F.col("category") == AUTH), F.lit(False)).alias("requires_auth"),
        F.when(F.col("http"), "http").otherwise("browser").alias("path"), F.when(F.col("http"), 0.9).otherwise(0.7).alias("confidence"),
    ]
    have = first.select(*columns)
    pages = nodes.select("domain", "page_type").distinct()
    search = F.struct(F.lit("Site").alias("model"), F.lit("search").alias("name"), F.lit("/search?q={query}").alias("endpoint"), F.lit(0.80).alias("confidence"))
    view = F.struct(F.lit("Cart").alias("model"), F.lit("view").alias("name"), F.lit("/cart").alias("endpoint"), F.lit(0.75).alias("confidence"))
    promised = pages.select("domain", F.when(F.col("page_type") == PAGE_TYPE["search_results"], search).when(F.col("page_type") == PAGE_TYPE["cart"], view).alias("p")).where("p IS NOT NULL").select("domain", "p.*")
    known = F.try_element_at(requests, F.col("name"))
    more = promised.join(have.select("domain", "model", "name"), ["domain", "model", "name"], "left_anti").select("domain", "model", "name", F.lit(False).alias("is_instance"), F.lit("GET").alias("method"), "endpoint", F.coalesce(known["params"], F.array().cast(PARAMS)).alias("params"), F.lit(False).alias("requires_auth"), F.lit("http").alias("path"), "confidence")
    return have.unionByName(more)
