"""Sitemaps and feeds of any size: files are cut at the ends of their entries by the text source, so that one file is read by many
tasks, and each entry is parsed by ``from_xml``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """(file, <schema>) of every element ``tag`` of the XML files at ``path``. Elements of one name must not contain each other."""
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", rf"(?s)<{tag}\b(?!.*<{tag}\b).*$", 0).alias("entry"))
    whole = pieces.where("entry <> ''").select("file", F.concat("entry", F.lit(f"</{tag}>")).alias("entry"))
    return whole.select("file", F.from_xml("entry", schema, {"rowTag": tag, "ignoreNamespace": "true"}).alias("x")).select("file", "x.*")


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod, priority) of sitemaps and sitemap indexes; entries of an index have priority 1.0, others 0.5 unless they say."""
    fields = "loc string, lastmod string, priority string"
    pages = entries(spark, path, "url", fields).withColumn("share", F.coalesce(F.col("priority").try_cast("double"), F.lit(0.5)))
    both = pages.unionByName(entries(spark, path, "sitemap", fields).withColumn("share", F.lit(1.0)))
    time = F.coalesce(F.try_to_timestamp("lastmod"), F.try_to_timestamp("lastmod", F.lit("yyyy-MM-dd")))
    return both.where("trim(loc) <> ''").select(F.trim("loc").alias("url"), time.alias("lastmod"), F.col("share").alias("priority"))


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, published, summary) of RSS items and Atom entries."""
    rss = entries(spark, path, "item", "title string, link string, guid string, pubDate string, description string").select("title", F.coalesce("link", "guid").alias("url"), F.col("pubDate").alias("published"), F.col("description").alias("summary"))
    atom = entries(spark, path, "entry", "title string, link struct<_href:string>, id string, published string, updated string, summary string").select("title", F.coalesce("link._href", "id").alias("url"), F.coalesce("published", "updated").alias("published"), "summary")
    return rss.unionByName(atom)
