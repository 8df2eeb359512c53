"""Column functions on URLs: parts, page type by path, robots rules, joining, origins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import PAGE_TYPE

# Path patterns, the page type they tell and how surely; first match wins. ^ starts with, $ ends with.
PATHS = (
    ("product_detail", 0.8, "/dp/ /product/ /item/ /p/ /products/ /pd/"),
    ("search_results", 0.8, "/search /s? ^/s/"),
    ("product_listing", 0.7, "/category/ /c/ /collections/ /shop/"),
    ("cart", 0.9, "/cart /basket /bag"),
    ("checkout", 0.9, "/checkout"),
    ("login", 0.85, "/login /signin /sign-in /auth"),
    ("account", 0.7, "/account /profile /settings"),
    ("article", 0.75, "/blog/ /post/ /article/ /news/ /stories/"),
    ("documentation", 0.7, "/docs/ /documentation/ /wiki/ /guide/"),
    ("about_page", 0.85, "/about"),
    ("contact_page", 0.85, "/contact"),
    ("faq", 0.8, "/faq /help"),
    ("pricing_page", 0.85, "/pricing /plans"),
    ("legal", 0.8, "/privacy /terms /tos /legal"),
    ("download_page", 0.8, "/download"),
    ("download_page", 0.9, "$.pdf $.zip $.tar.gz"),
    ("media_page", 0.9, "$.jpg $.png $.gif $.mp4"),
    ("forum", 0.7, "/forum /discuss /community"),
    ("sitemap_page", 0.8, "/sitemap"),
    ("product_listing", 0.5, "/archive /tags/ /categories/"),
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def site(url: Column) -> Column:
    """Host without user, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r":\d*$", ""), r"^www\.", "")


def target(url: Column) -> Column:
    """Path with query and fragment; ``/`` if there is none."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.when(rest.startswith("/"), rest).when(rest == "", "/").otherwise(F.concat(F.lit("/"), rest))


def path(url: Column) -> Column:
    return F.regexp_replace(target(url), r"[?#].*$", "")


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def parent_path(url: Column) -> Column:
    """Path without its last segment; null at the root."""
    own = F.regexp_replace(path(url), r"/+$", "")
    return F.when(own == "", F.lit(None).cast("string")).otherwise(F.when(own.rlike(r"^/[^/]*$"), "/").otherwise(F.regexp_replace(own, r"/[^/]*$", "")))


def prefix(url: Column, segments: int = 1) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path(url), "/"), lambda s: s != ""), 1, segments), "/"))


def classify(url: Column) -> Column:
    """struct(page_type code, confidence) by the first path pattern."""
    low = F.lower(target(url))
    both = lambda name, conf: F.struct(F.lit(PAGE_TYPE[name]).alias("page_type"), F.lit(conf).alias("confidence"))
    out = F.when(low == "/", both("home", 0.9))
    for name, conf, patterns in PATHS:
        hit = F.lit(False)
        for p in patterns.split():
            hit = hit | (low.startswith(p[1:]) if p[0] == "^" else low.endswith(p[1:]) if p[0] == "$" else low.contains(p))
        out = out.when(hit, both(name, conf))
    return out.otherwise(both("unknown", 0.3))


def same_site(a: Column, b: Column) -> Column:
    return site(a) == site(b)


def same_origin(a: Column, b: Column) -> Column:
    origin = lambda u: F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    return origin(a) == origin(b)


def normal_domain(text: Column) -> Column:
    """A site name from whatever a user types: scheme, www., port, path and case dropped."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r":\d*$", ""), r"^www\.", "")


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """A reference joined to its base as RFC 3986 says; null stays null."""
    from urllib.parse import urljoin

    def one(b, r):
        if b is None or r is None:
            return None
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def html_pages(heads: DataFrame) -> DataFrame:
    """Rows with status 200 that are HTML or don't say what they are."""
    return heads.where((F.col("status") == 200) & F.coalesce(F.lower(F.col("content_type")).contains("html"), F.lit(True)))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: of a domain's rules (domain, kind allow|disallow, pattern) the longest that fits decides, allow on
    ties, no rule allows. ``*`` ends a prefix pattern, ``$`` makes it exact. A row carries the few lengths that its domain's rules have,
    never the rules: its path's beginnings of those lengths meet the rules by an equi-join."""
    exact = F.endswith("pattern", F.lit("$"))
    bare = F.when(exact, F.regexp_replace("pattern", r"\$$", "")).otherwise(F.regexp_replace("pattern", r"\*+$", ""))
    told = rules.where("pattern <> ''").select("domain", exact.alias("_exact"), bare.alias("_start"), F.struct(F.length("pattern").alias("size"), (F.col("kind") == "allow").alias("allow")).alias("_rule"))
    best = told.groupBy("domain", "_exact", "_start").agg(F.max("_rule").alias("_rule"))
    lengths = best.select("domain", F.struct(F.length("_start").alias("size"), F.col("_exact").alias("exact")).alias("x")).groupBy("domain").agg(F.collect_set("x").alias("_lengths"))
    row = F.struct(*[F.col(c) for c in urls.columns])
    keyed = urls.select("domain", row.alias("_row"), path(F.col("url")).alias("_path"), F.monotonically_increasing_id().alias("_id")).join(lengths, "domain", "left")
    own = F.filter("_lengths", lambda x: F.when(x["exact"], x["size"] == F.length("_path")).otherwise(x["size"] <= F.length("_path")))
    each = keyed.select("domain", "_row", "_id", "_path", F.explode_outer(own).alias("_x")).select("domain", "_row", "_id", F.col("_x.exact").alias("_exact"), F.expr("substring(_path, 1, _x.size)").alias("_start"))
    met = each.join(best, ["domain", "_exact", "_start"], "left").groupBy("_id").agg(F.first("_row").alias("_row"), F.max("_rule").alias("_rule"))
    return met.select("_row.*", F.coalesce("_rule.allow", F.lit(True)).alias("allowed"))
