"""Schemas inferred from typed pages, unified across sites, compared between sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import PAGE_TYPE, SCHEMA_TYPE, SHORT_NAME, lookup, name_of, PAGE_TYPES
from ..functions.text import canonical_field
from .graph import written

LEAST_CONFIDENCE = 0.3
# Fixed values: (field, type, dimension, page types it belongs to; none: all).
FIELDS = (
    ("price", "float", 48, "product_detail pricing_page"), ("original_price", "float", 49, "product_detail"), ("discount_percent", "float", 50, "product_detail"),
    ("availability", "enum(in_stock,out_of_stock,preorder)", 51, "product_detail"), ("rating", "float", 52, "product_detail review_list article"),
    ("review_count", "integer", 53, "product_detail review_list"), ("review_sentiment", "float", 54, "product_detail review_list"),
    ("free_shipping", "bool", 55, "product_detail"), ("shipping_speed_days", "integer", 56, "product_detail"), ("seller_reputation", "float", 58, "product_detail"),
    ("variant_count", "integer", 59, "product_detail"), ("deal_score", "float", 63, "product_detail"), ("category_price_percentile", "float", 62, "product_detail"),
    ("word_count", "integer", 17, "article documentation"), ("reading_level", "float", 29, "article documentation"), ("sentiment", "float", 30, "article"),
    ("image_count", "integer", 20, ""), ("has_video", "bool", 21, ""), ("breadcrumb_depth", "integer", 67, ""),
)
# Fields that pages with structured data of a type have.
TYPE_FIELDS = {
    "Product": "brand:string category:string sku:string image_url:url description:string currency:string",
    "Article": "author:string published_date:datetime category:string image_url:url description:string",
    "Organization": "description:string logo_url:url address:string phone:string email:string",
    "Event": "start_date:datetime end_date:datetime location:string organizer:string description:string",
    "Review": "author:string body:string date_published:datetime",
    "Offer": "description:string valid_from:datetime valid_through:datetime",
}
#: Types that a site has one page of.
SINGLE = ("WebSite", "Cart", "CheckoutPage", "LoginPage", "Account", "Organization", "ContactPoint")


def typed(nodes: DataFrame) -> DataFrame:
    """Pages sure enough of a type that has a vocabulary type: adds type_name, schema_type and model."""
    name = name_of(PAGE_TYPES, F.col("page_type"))
    known = nodes.where(F.col("confidence") / 255.0 >= LEAST_CONFIDENCE).withColumn("type_name", name).withColumn("schema_type", lookup(SCHEMA_TYPE, F.col("type_name")))
    return known.where("schema_type is not null").withColumn("model", F.coalesce(lookup(SHORT_NAME, F.col("schema_type")), F.col("schema_type")))


def models(nodes: DataFrame) -> DataFrame:
    """(domain, model, schema_type, instances): types of two pages or more, one for types that a site has once."""
    counts = typed(nodes).groupBy("domain", "model", "schema_type").agg(F.count("*").alias("instances"))
    return counts.where((F.col("instances") >= 2) | F.col("schema_type").isin(*SINGLE))


def shown(dim: int, value):
    """A feature value as an example text; counts are stored as log(n + 1) / 10."""
    if dim in (48, 49):
        return F.format_string("%.2f", value)
    if dim == 50:
        return F.format_string("%.0f%%", value * 100)
    if dim == 52:
        return F.format_string("%.1f", value)
    if dim == 53:
        return F.round(F.exp(value * 10) - 1).cast("long").cast("string")
    return F.when(value > 0.5, "in_stock").otherwise("out_of_stock") if dim == 51 else F.format_string("%.2f", value)


def observations_of_fields(nodes: DataFrame) -> DataFrame:
    """(domain, model, node_id, field, type, example): the known fields of every typed page, long form."""
    rows = []
    for name, kind, dim, pages in FIELDS:
        value = F.get("features", F.lit(dim)).cast("double")
        fits = (value != 0) if name != "has_video" else (value > 0.5)
        if pages:
            fits = fits & F.col("page_type").isin([PAGE_TYPE[p] for p in pages.split()])
        rows.append(F.when(fits, F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), shown(dim, value).alias("example"))))
    each = F.array_compact(F.array(*rows))
    return typed(nodes).select("domain", "model", "schema_type", "node_id", "confidence", F.explode(each).alias("f")).select("domain", "model", "schema_type", "node_id", "confidence", "f.*")


def fields(nodes: DataFrame) -> DataFrame:
    """(domain, model, field, type, occurrences, instances, nullable, confidence, examples): url and node_id always, the
    observed fields, and the vocabulary's fields for types with structured data."""
    # One pass: a row per page and field, and one per page (of no field), counted by example first, so that no group gathers all.
    page = typed(nodes).select("domain", "model", "schema_type", "confidence", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("example"), F.get("features", F.lit(13)).alias("data"))
    each = observations_of_fields(nodes).select("domain", "model", "schema_type", "confidence", "field", "type", "example", F.lit(None).cast("float").alias("data"))
    keys = ["domain", "model", "schema_type", "field", "type"]
    counted = page.unionByName(each).groupBy(*keys, "example").agg(F.count("*").alias("n"), F.sum(F.col("confidence") / 255.0).alias("sure"), F.max("data").alias("data"))
    counted = written(counted, "fields")
    pages = counted.where("field is null")
    known = pages.select("domain", "model", "schema_type", F.col("n").alias("instances")).where((F.col("instances") >= 2) | F.col("schema_type").isin(*SINGLE))
    rest = counted.where("field is not null")
    first = rest.withColumn("at", F.row_number().over(W.partitionBy("domain", "model", "field", "type").orderBy("example"))).where("at <= 5")
    some = first.groupBy("domain", "model", "field", "type").agg(F.sort_array(F.collect_list("example")).alias("examples"))
    found = rest.groupBy("domain", "model", "field", "type").agg(F.sum("n").alias("occurrences"), (F.sum("sure") / F.sum("n")).alias("confidence")).join(some, ["domain", "model", "field", "type"])
    observed = known.join(found, ["domain", "model"]).withColumn("nullable", F.col("occurrences") < F.col("instances"))
    cols = ["domain", "model", "field", "type", "occurrences", "instances", "nullable", "confidence", "examples"]
    none = F.array().cast("array<string>")
    always = known.select("domain", "model", F.explode(F.array(F.struct(F.lit("url").alias("field"), F.lit("url").alias("type")), F.struct(F.lit("node_id").alias("field"), F.lit("integer").alias("type")))).alias("f"), "instances").select("domain", "model", "f.field", "f.type", F.col("instances").alias("occurrences"), "instances", F.lit(False).alias("nullable"), F.lit(1.0).alias("confidence"), none.alias("examples"))
    by_type = F.create_map(*[x for k, v in TYPE_FIELDS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(f.split(":")[0]).alias("field"), F.lit(f.split(":")[1]).alias("type")) for f in v.split()]))])
    structured = pages.groupBy("domain", "model").agg(F.max("data").alias("data"))
    vocabulary = known.join(structured.where("data > 0"), ["domain", "model"]).select("domain", "model", F.explode(F.try_element_at(by_type, F.col("schema_type"))).alias("f"), "instances").select("domain", "model", "f.field", "f.type", F.lit(0).cast("long").alias("occurrences"), "instances", F.lit(True).alias("nullable"), F.lit(0.99).alias("confidence"), none.alias("examples"))
    return always.unionByName(observed.select(*cols)).unionByName(vocabulary.join(observed.select("domain", "model", "field"), ["domain", "model", "field"], "left_anti").select(*cols))


def totals(nodes: DataFrame) -> DataFrame:
    """One row: models, fields, instances and mean field confidence."""
    m, f = models(nodes), fields(nodes)
    return m.agg(F.count("*").alias("models"), F.coalesce(F.sum("instances"), F.lit(0)).alias("instances")).join(f.agg(F.count("*").alias("fields"), F.avg("confidence").alias("avg_confidence")), F.lit(True))


def unified_fields(found: DataFrame) -> DataFrame:
    """From (domain, type, field): (type, field, domains_with_field, domains, coverage); aliases are one field."""
    own = found.select("domain", "type", canonical_field(F.col("field")).alias("field")).distinct()
    with_field = own.groupBy("type", "field").agg(F.count("*").alias("domains_with_field"))
    all_of = own.select("domain", "type").distinct().groupBy("type").agg(F.count("*").alias("domains"))
    return with_field.join(all_of, "type").withColumn("coverage", F.col("domains_with_field") / F.col("domains"))


def field_sources(found: DataFrame) -> DataFrame:
    """From (domain, type, field): which of a type's unified fields each site has: (type, field, domain, present)."""
    own = found.select("domain", "type", canonical_field(F.col("field")).alias("field")).distinct()
    sites, names = own.select("domain", "type").distinct(), own.select("type", "field").distinct()
    return names.join(sites, "type").join(own.withColumn("present", F.lit(True)), ["domain", "type", "field"], "left").select("type", "field", "domain", F.coalesce("present", F.lit(False)).alias("present"))


def unified_models(found: DataFrame) -> DataFrame:
    """From (domain, type, model, instances): (type, name, sources, total_instances); most common model name, then first."""
    names = found.groupBy("type", "model").agg(F.count("*").alias("n"))
    best = names.groupBy("type").agg(F.min(F.struct((-F.col("n")).alias("n"), "model")).alias("m")).select("type", F.col("m.model").alias("name"))
    return found.groupBy("type").agg(F.countDistinct("domain").alias("sources"), F.sum("instances").alias("total_instances")).join(best, "type")


def site_overlap(items: DataFrame, site: str, item: str) -> DataFrame:
    """(a, b, common, jaccard rounded to 3): pairs of sites that share an item; an equi-join on the items, so sites with
    nothing in common cost nothing."""
    own = written(items.select(F.col(site).alias("site"), F.col(item).alias("item")).distinct(), "items")  # a join of tables: Spark splits frequent items
    sizes = own.groupBy("site").agg(F.count("*").alias("n"))
    met = own.alias("x").join(own.alias("y"), F.col("x.item") == F.col("y.item")).where("x.site < y.site").groupBy(F.col("x.site").alias("a"), F.col("y.site").alias("b")).agg(F.count("*").alias("common"))
    joined = met.join(sizes.select(F.col("site").alias("a"), F.col("n").alias("an")), "a").join(sizes.select(F.col("site").alias("b"), F.col("n").alias("bn")), "b")
    return joined.select("a", "b", "common", F.round(F.col("common") / (F.col("an") + F.col("bn") - F.col("common")), 3).alias("jaccard"))


def common_items(items: DataFrame, site: str, item: str) -> DataFrame:
    """Items that every site has."""
    n = items.select(site).distinct().count()
    return items.groupBy(item).agg(F.countDistinct(site).alias("sites")).where(F.col("sites") == n).select(item)


def unique_items(items: DataFrame, site: str, item: str) -> DataFrame:
    """(site, item) of items that one site alone has."""
    return items.groupBy(item).agg(F.countDistinct(site).alias("sites"), F.min(site).alias(site)).where("sites = 1").select(site, item)


def actions(found: DataFrame) -> DataFrame:
    """Distinct (model, category, action) of a site's action records with their nodes counted."""
    return found.groupBy("model", "category", "action").agg(F.countDistinct("node_id").alias("nodes"), F.max("risk").alias("risk"))


# Names of field types in other type systems; what isn't named is text.
TYPE_NAMES = {
    "python": {"string": "str", "float": "float", "integer": "int", "bool": "bool", "datetime": "datetime", "url": "str"},
    "typescript": {"string": "string", "float": "number", "integer": "number", "bool": "boolean", "datetime": "string", "url": "string"},
    "openapi": {"string": "string", "float": "number", "integer": "integer", "bool": "boolean", "datetime": "string", "url": "string"},
    "graphql": {"string": "String", "float": "Float", "integer": "Int", "bool": "Boolean", "datetime": "String", "url": "String"},
}


def type_in(system: str, kind: Column) -> Column:
    """A field type's name in another type system; ``enum(a,b)`` lists its values where the system can."""
    names = TYPE_NAMES[system]
    values = F.transform(F.split(F.regexp_extract(kind, r"^enum\((.*)\)$", 1), ","), lambda v: F.concat(F.lit('"'), F.trim(v), F.lit('"')))
    plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind), F.lit(names["string"]))
    listed = {"python": F.concat(F.lit("Literal["), F.array_join(values, ", "), F.lit("]")), "typescript": F.array_join(values, " | ")}.get(system, F.lit(names["string"]))
    return F.when(kind.startswith("enum("), listed).otherwise(plain)


def ddl(found: DataFrame, model: str) -> str:
    """A model's inferred fields as a Spark schema string (one model: few rows)."""
    kinds = {"float": "DOUBLE", "integer": "BIGINT", "bool": "BOOLEAN", "datetime": "TIMESTAMP"}
    rows = found.where(F.col("model") == model).select("field", "type").distinct().orderBy("field").collect()
    return ", ".join(f"{r.field} {kinds.get(r.type, 'STRING')}" for r in rows)


def top_models(found: DataFrame, n: int) -> DataFrame:
    """The n models with most instances, ranked from 1."""
    first = found.orderBy(F.desc("total_instances"), "type").limit(n)
    return first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total_instances"), "type")))  # n rows
