"""JSON inside pages as VARIANT columns: things of JSON-LD blocks, whatever their nesting, and their fields as strings or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import PAGE_TYPE
from .html_data import LD_PAGES

BLOCK = r"(?is)<script\b[^>]*?application/ld\+json[^>]*>(.*?)</script"


def _items(v: Column) -> Column:
    """A list's members, or the value itself."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def things(pages: DataFrame, *kept: str, html: str = "html") -> DataFrame:
    """(kept.., block int, place int, thing variant) of every object of every JSON-LD block: of lists and of ``@graph`` the members, too. Blocks
    that aren't JSON have none."""
    blocks = pages.select(*kept, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(1))).alias("block", "_raw")).withColumn("_v", F.try_parse_json("_raw")).where("_v IS NOT NULL")
    listed = F.flatten(F.transform(_items(F.col("_v")), lambda v: F.concat(F.array(v), F.coalesce(F.transform(F.try_variant_get(v, "$['@graph']", "array<variant>"), lambda g: g), F.array().cast("array<variant>")))))
    each = blocks.select(*kept, "block", F.posexplode(listed).alias("place", "thing"))
    return each.where(F.schema_of_variant("thing").startswith("OBJECT"))


def text_at(v: Column, *paths: str) -> Column:
    """The first of some paths as a string; numbers and booleans as they are written."""
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def number_at(v: Column, *paths: str) -> Column:
    """The first of some paths as a number, given as a number or as a string of one."""
    return F.coalesce(*[x for p in paths for x in (F.try_variant_get(v, p, "double"), F.try_variant_get(v, p, "string").try_cast("double"))])


def kind_of(v: Column) -> Column:
    """A thing's type, the first where it has several."""
    return text_at(v, "$['@type'][0]", "$['@type']")


def page_type_of(v: Column) -> Column:
    """Page type code that a thing's type tells; null if none."""
    codes = F.create_map(*[F.lit(x) for k, name in LD_PAGES.items() for x in (k, PAGE_TYPE[name])])
    return F.try_element_at(codes, F.lower(kind_of(v)))


def products(pages: DataFrame, *kept: str) -> DataFrame:
    """(kept.., name, price, currency, availability, rating, reviews) of products, offers given as one or as a list."""
    t = F.col("thing")
    offer = lambda f: (f"$.offers[0].{f}", f"$.offers.{f}")
    return things(pages, *kept).where(kind_of(t) == "Product").select(
        *kept, text_at(t, "$.name").alias("name"), number_at(t, *offer("price"), *offer("lowPrice")).alias("price"), text_at(t, *offer("priceCurrency")).alias("currency"),
        F.regexp_extract(text_at(t, *offer("availability")), r"([^/]*)$", 1).alias("availability"), number_at(t, "$.aggregateRating.ratingValue").alias("rating"), number_at(t, "$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount").cast("long").alias("reviews"),
    )
