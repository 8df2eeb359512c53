"""Fixed vocabulary of the data model, and DataFrame schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Page type names by code.
PAGE_TYPES = (
    "unknown home search_results product_listing product_detail article documentation form_page login checkout cart account "
    "error_page captcha media_page comparison review_list map_location dashboard api_docs legal download_page social_feed forum "
    "messaging calendar file_browser pricing_page about_page contact_page faq sitemap_page"
).split()
PAGE_TYPE = {name: code for code, name in enumerate(PAGE_TYPES)}

# Edge type names by code.
EDGE_TYPES = "navigation content_link pagination related breadcrumb form_submit action_result redirect external anchor".split()
EDGE_TYPE = {name: code for code, name in enumerate(EDGE_TYPES)}

# Bits of node and edge flags.
NODE_FLAGS = {name: 1 << bit for bit, name in enumerate("rendered estimated stale blocked auth_required has_form has_price has_media".split())}
EDGE_FLAGS = {name: 1 << bit for bit, name in enumerate("requires_auth requires_form changes_state opens_new_context is_download is_nofollow".split())}

FEATURE_DIM = 128

# The feature dimensions that have a name here.
DIM = {
    "page_type": 0, "page_type_confidence": 1, "content_language": 2, "page_depth": 3, "is_auth_area": 4, "has_paywall": 5,
    "is_mobile_optimized": 6, "load_time": 7, "is_https": 8, "url_path_depth": 9, "url_has_query": 10, "url_has_fragment": 11,
    "is_canonical": 12, "has_structured_data": 13, "meta_robots_index": 14, "text_density": 16, "text_length_log": 17, "heading_count": 18,
    "paragraph_count": 19, "image_count": 20, "video_present": 21, "table_count": 22, "list_count": 23, "form_field_count": 24,
    "link_count_internal": 25, "link_count_external": 26, "reading_level": 29, "sentiment": 30, "structured_data_richness": 47,
    "price": 48, "price_original": 49, "discount_pct": 50, "availability": 51, "rating": 52, "review_count_log": 53,
    "review_sentiment": 54, "shipping_free": 55, "shipping_speed": 56, "seller_reputation": 58, "variant_count": 59,
    "category_price_percentile": 62, "deal_score": 63, "outbound_links": 64, "pagination_present": 65, "breadcrumb_depth": 67,
    "search_available": 69, "is_dead_end": 74, "tls_valid": 80, "cookie_consent_blocking": 88, "popup_count": 89,
    "content_freshness": 93, "action_count": 96, "safe_action_ratio": 97, "cautious_action_ratio": 98,
    "destructive_action_ratio": 99, "auth_required_ratio": 100, "form_completeness": 101, "primary_cta_present": 106,
    "session_first": 112, "session_last": 127,
}

# Query model names and the page type that each stands for.
MODEL_PAGE_TYPE = {
    "Product": "product_detail", "Category": "product_listing", "ProductListing": "product_listing", "Article": "article",
    "Review": "review_list", "FAQ": "faq", "Organization": "about_page", "Contact": "contact_page", "Cart": "cart",
    "Checkout": "checkout", "Account": "account", "Media": "media_page", "Site": "home", "WebSite": "home", "Home": "home",
    "Event": "calendar", "Documentation": "documentation", "Docs": "documentation", "Forum": "forum", "Discussion": "forum",
    "Search": "search_results", "SearchResults": "search_results",
}

# Fields that a model exposes, by feature dimension; counts are whole numbers.
MODEL_FIELDS = {
    "Product": {"price": 48, "original_price": 49, "discount_percent": 50, "availability": 51, "rating": 52, "review_count": 53, "seller_reputation": 58, "variant_count": 59, "deal_score": 63},
    "Article": {"word_count": 17, "reading_level": 29, "sentiment": 30, "rating": 52, "image_count": 20},
    None: {"rating": 52, "image_count": 20},
}
WHOLE_FIELDS = {"review_count", "variant_count", "word_count", "image_count"}

# Vocabulary type of each page type, and the short model name of types that have one.
SCHEMA_TYPE = {
    "product_detail": "Product", "product_listing": "ProductListing", "article": "Article", "review_list": "Review", "faq": "FAQPage",
    "about_page": "Organization", "contact_page": "ContactPoint", "pricing_page": "Offer", "documentation": "TechArticle",
    "media_page": "MediaObject", "forum": "DiscussionForumPosting", "social_feed": "SocialMediaPosting", "calendar": "Event",
    "cart": "Cart", "checkout": "CheckoutPage", "account": "Account", "login": "LoginPage", "home": "WebSite",
    "search_results": "SearchResultsPage", "dashboard": "Dashboard",
}
SHORT_NAME = {
    "FAQPage": "FAQ", "TechArticle": "Article", "MediaObject": "Media", "DiscussionForumPosting": "ForumPost",
    "SocialMediaPosting": "SocialPost", "ContactPoint": "Contact", "CheckoutPage": "Checkout", "LoginPage": "Auth", "WebSite": "Site",
    "SearchResultsPage": "SearchResults", "ProductListing": "Category",
}

# Field names and the names they are aliases of.
FIELD_ALIASES = {
    "price": ("cost", "amount"), "rating": ("score", "stars"), "name": ("title", "label"), "url": ("link", "href"),
    "node_id": ("id", "nodeId"), "image_url": ("image", "thumbnail", "picture"), "description": ("desc", "summary", "blurb"),
    "category": ("type", "kind"), "brand": ("manufacturer", "maker"), "availability": ("in_stock", "stock"),
}

NODES = (
    "domain string, node_id int, url string, page_type tinyint, confidence smallint, freshness smallint, flags smallint, content_hash bigint, "
    "rendered_at bigint, http_status int, depth int, inbound_count int, outbound_count int, feature_norm float, features array<float>"
)
EDGES = "domain string, src int, dst int, edge_type tinyint, weight smallint, flags smallint"
ACTIONS = "domain string, node_id int, category tinyint, action tinyint, target_node int, cost_hint smallint, risk smallint, http_executable boolean"
HISTORY = "domain string, url string, field string, ts timestamp, value double"


def code_of(names: dict[str, int], name: Column, default: int = 0) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in names.items()], F.lit(default))


def name_of(names: list[str], code: Column) -> Column:
    """Name of a code; codes out of range are the first name."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code.cast("int")), F.lit(names[0]))


def lookup(pairs: dict[str, str], value: Column) -> Column:
    """A small fixed mapping as a literal map; null where it has no entry."""
    entries = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*entries), value)


def feature(dim: int, features: str = "features") -> Column:
    """A feature by dimension; 0 means unknown and is null."""
    return F.nullif(F.get(F.col(features), F.lit(dim)).cast("double"), F.lit(0.0))


def fields_of(model: str) -> dict[str, int]:
    return MODEL_FIELDS.get(model, MODEL_FIELDS[None])


def model_view(nodes: DataFrame, model: str) -> DataFrame:
    """Rows of one query model: domain, url, node_id and its fields. Unknown models raise."""
    if model not in MODEL_PAGE_TYPE:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(sorted(MODEL_PAGE_TYPE))}")
    code = PAGE_TYPE[MODEL_PAGE_TYPE[model]]
    fields = [(feature(d).cast("bigint") if name in WHOLE_FIELDS else feature(d)).alias(name) for name, d in fields_of(model).items()]
    return nodes.where(F.col("page_type") == code).select("domain", "url", "node_id", *fields)


def models_of(nodes: DataFrame) -> dict[str, DataFrame]:
    return {m: model_view(nodes, m) for m in MODEL_PAGE_TYPE}


def page_type_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, SCHEMA_TYPE.get(n), SHORT_NAME.get(SCHEMA_TYPE.get(n, ""), SCHEMA_TYPE.get(n))) for i, n in enumerate(PAGE_TYPES)]
    return spark.createDataFrame(rows, "code int, name string, schema_type string, model string")
