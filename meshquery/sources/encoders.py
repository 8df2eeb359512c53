"""The 128 features of pages from their elements: one vector from what a page shows, one from what packs of selectors find on it.
(``html_data.features`` is the third, from structured data.) A page's elements are counted in one grouping; no element travels.

Defined results: a page without elements has the features of its address only; 0 is unknown; a page without links is a dead end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DIM, FEATURE_DIM, NODE_FLAGS
from ..functions import urls
from . import dom as tree
from . import selectors

HEADINGS, FIELDS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("input", "select", "textarea")
NOT_FIELDS = ("hidden", "submit", "button", "reset", "image")
MARKS = [
    '[class*="pagin"], [rel="next"]',
    '[class*="breadcrumb"] a, [aria-label*="readcrumb"] a',
    'input[type="search"], input[name="q"], input[name="query"], input[name="search"], [role="search"]',
]
#: Categories of actions that a page is there for: buying and signing in.
CALLS_TO_ACTION = (2, 4)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def vector(known: dict[str, Column]) -> Column:
    """array<float> of all features; those not named, and nulls, are 0."""
    at = {DIM[k]: v for k, v in known.items()}
    return F.array(*[F.coalesce(at[i].cast("float"), F.lit(0.0).cast("float")) if i in at else F.lit(0.0).cast("float") for i in range(FEATURE_DIM)])


def of_address(url: Column, kind: Column) -> dict[str, Column]:
    """Features that an address and a page's kind, struct(page_type, confidence), tell."""
    secure = F.when(url.startswith("https://"), 1.0)
    return {
        "page_type": kind["page_type"] / 31.0, "page_type_confidence": kind["confidence"], "is_https": secure, "tls_valid": secure, "url_path_depth": urls.path_depth(url) / 10.0,
        "url_has_query": F.when(url.contains("?"), 1.0), "url_has_fragment": F.when(url.contains("#"), 1.0),
    }


def of_patterns() -> dict[str, Column]:
    """Shop features of the columns of ``selectors.patterns``."""
    return {"price": F.col("price"), "availability": F.col("availability"), "rating": F.col("rating"), "review_count_log": clamp(F.log1p(F.col("review_count").cast("double")) / 10)}


def counted(dom: DataFrame) -> DataFrame:
    """A row per page with elements: how many headings, paragraphs, images, tables, lists, fields, inner and outer links it has, and
    whether film, sound, pages to turn, a trail and a search are there."""
    elements, by_page = tree.elements(dom), tree.dealer(dom)
    home = dom.select("page", urls.site(F.col("url")).alias("home"))
    href = F.try_element_at(F.col("attrs"), F.lit("href"))
    absolute, other = href.rlike(r"^(?i:https?:)?//"), href.rlike(r"^(?i:[a-z][a-z0-9+.-]*):") & ~href.rlike(r"^(?i:https?)://")
    link = (F.col("tag") == "a") & href.isNotNull() & ~href.startswith("#") & ~other
    full = F.when(href.startswith("//"), F.concat(F.lit("http:"), href)).otherwise(href)
    shown = F.lower(F.coalesce(F.try_element_at(F.col("attrs"), F.lit("type")), F.lit("")))
    # per page and kind of link first: a page's site is joined to at most a row per host it links to
    rows = elements.select("page", "tag", F.when(link, F.when(absolute, urls.site(full)).otherwise("")).alias("to"), (F.col("tag").isin(*FIELDS) & ~shown.isin(*NOT_FIELDS)).alias("field"))
    of = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    by_host = rows.groupBy("page", "to").agg(F.count("*").alias("n"), of(*HEADINGS).alias("headings"), of("p").alias("paragraphs"), of("img", "picture").alias("images"), of("table").alias("tables"), of("ul", "ol").alias("lists"), of("video").alias("films"), of("audio").alias("sounds"), of("form").alias("forms"), F.count_if("field").alias("fields"))
    named = ("headings", "paragraphs", "images", "tables", "lists", "films", "sounds", "forms", "fields")
    inner = F.col("to").isNotNull() & ((F.col("to") == "") | (F.col("to") == F.coalesce("home", F.lit(""))))
    sums = by_page(by_host).join(tree.large(by_page(home)), "page").groupBy("page").agg(F.sum("n").alias("elements"), *[F.sum(c).alias(c) for c in named], F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("inner_links"), F.sum(F.when(F.col("to").isNotNull() & ~inner, F.col("n")).otherwise(0)).alias("outer_links"))
    marks = by_page(tree.select(elements, MARKS).select("page", "selector")).groupBy("page").agg(*[F.count_if(F.col("selector") == i).alias(c) for i, c in enumerate(("turns", "crumbs", "searches"))])
    return sums.join(tree.large(marks), "page", "left").na.fill(0, ["turns", "crumbs", "searches"])


def acted(actions: DataFrame) -> DataFrame:
    """(page, acts, safe, cautious, destructive, called) of ``selectors.actions`` rows: shares by risk, which is the doubt in thirds."""
    risk = F.least(F.floor((1 - F.col("confidence")) * 3 + 1e-9), F.lit(3))
    share = lambda n: F.count_if(risk == n) / F.count("*")
    return actions.groupBy("page").agg(F.count("*").alias("acts"), share(0).alias("safe"), share(1).alias("cautious"), share(2).alias("destructive"), F.max(F.col("category").isin(*CALLS_TO_ACTION).cast("int")).alias("called"))


def rendered(dom: DataFrame, *kept: str) -> DataFrame:
    """(page, url, kept.., page_type, confidence, features, flags) of parsed pages with a column url, as they show: elements, text, prices and
    ratings, navigation, actions. The page's kind is that of its classes and names if one of the packs tells it, else its address's."""
    found = selectors.patterns(dom, "url", *kept)
    by_page = tree.dealer(dom)
    size = selectors.body_text(dom).select("page", F.octet_length("said").alias("bytes"), F.length("said").alias("chars"))
    done = acted(by_page(selectors.actions(dom)))
    rows = found.join(tree.large(counted(dom)), "page", "left").join(tree.large(by_page(size)), "page", "left").join(tree.large(done), "page", "left").withColumn("_url", urls.classify(F.col("url")))
    told = F.col("page_type").isNotNull()
    kind = F.struct(F.when(told, F.col("page_type")).otherwise(F.col("_url.page_type")).cast("int").alias("page_type"), F.when(told, F.col("page_type_confidence")).otherwise(F.col("_url.confidence")).cast("double").alias("confidence"))
    part = lambda c, of: clamp(F.coalesce(F.col(c), F.lit(0)) / float(of))
    links = F.coalesce(F.col("inner_links") + F.col("outer_links"), F.lit(0))
    known = of_address(F.col("url"), F.col("kind")) | of_patterns() | {
        "text_density": F.col("chars") / F.col("elements"), "text_length_log": clamp(F.log1p(F.col("bytes").cast("double")) / 12), "heading_count": part("headings", 10), "paragraph_count": part("paragraphs", 20),
        "image_count": part("images", 20), "video_present": F.when(F.col("films") > 0, 1.0), "table_count": part("tables", 5), "list_count": part("lists", 10), "form_field_count": part("fields", 20),
        "link_count_internal": part("inner_links", 100), "link_count_external": part("outer_links", 50), "outbound_links": clamp(links / 100.0), "pagination_present": F.when(F.col("turns") > 0, 1.0),
        "breadcrumb_depth": part("crumbs", 5), "search_available": F.when(F.col("searches") > 0, 1.0), "is_dead_end": F.when(links == 0, 1.0), "content_freshness": F.lit(1.0), "action_count": part("acts", 20),
        "safe_action_ratio": F.col("safe"), "cautious_action_ratio": F.col("cautious"), "destructive_action_ratio": F.col("destructive"), "primary_cta_present": F.col("called"),
    }
    bit = lambda name, cond: F.when(cond, F.lit(NODE_FLAGS[name])).otherwise(F.lit(0))
    flags = F.lit(NODE_FLAGS["rendered"]).bitwiseOR(bit("has_form", F.col("fields") > 0)).bitwiseOR(bit("has_price", F.col("price").isNotNull())).bitwiseOR(bit("has_media", F.col("films") + F.col("sounds") > 0))
    return rows.withColumn("kind", kind).select("page", "url", *kept, F.col("kind.page_type").alias("page_type"), F.col("kind.confidence").alias("confidence"), vector(known).alias("features"), flags.alias("flags"))


def from_patterns(dom: DataFrame, *kept: str) -> DataFrame:
    """(page, url, kept.., page_type, confidence, features) by the packs of selectors alone; page_type and confidence are null where no pack tells it."""
    by_page = tree.dealer(dom)
    forms = by_page(selectors.forms(dom)).groupBy("page").agg(F.count("*").alias("forms"), F.sum(F.size("fields")).alias("fields"))
    rows = selectors.patterns(dom, "url", *kept).join(tree.large(forms), "page", "left").join(tree.large(acted(by_page(selectors.actions(dom)))), "page", "left")
    done = F.coalesce("acts", F.lit(0)) + F.coalesce("forms", F.lit(0))
    known = of_address(F.col("url"), F.struct("page_type", F.col("page_type_confidence").alias("confidence"))) | of_patterns() | {
        "form_field_count": clamp(F.col("fields") / 20.0), "is_dead_end": F.when(done == 0, 1.0), "content_freshness": F.lit(1.0), "action_count": clamp(done / 20.0), "primary_cta_present": F.col("called"),
    }
    return rows.select("page", "url", *kept, "page_type", F.col("page_type_confidence").alias("confidence"), vector(known).alias("features"))
