"""A tree of hashes over sites, so that two registries find where they differ without reading all of either.

A site's place in the tree is the hash of its name, so trees of any two registries have the same shape. A node's digest is made of its
children's in order. Levels are tables, leaves lie in folders by the first two digits of their place; comparing goes down level by level and joins only
children of nodes that differ, and reads only the folders of leaves that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, TOP = 4, 2


def _digest(parts: list[str], what: str) -> F.Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat(x[parts[0]], F.lit("="), x[what])), ","), 256).alias("digest")


def write(leaves: DataFrame, path: str, depth: int = DEPTH) -> None:
    """Writes the tree of (domain, digest), one row per domain, with 16 ** depth places at its lowest level."""
    place = F.substring(F.md5(F.col("domain").cast("binary")), 1, depth)
    placed = leaves.select("domain", "digest", place.alias("place"))
    top = F.substring("place", 1, TOP)
    placed.withColumn("top", top).repartition("top").sortWithinPartitions("place").write.mode("overwrite").partitionBy("top").parquet(f"{path}/leaves")
    level = placed.groupBy("place").agg(_digest(["domain", "digest"], "digest"), F.count("*").alias("sites"))
    for at in range(depth, -1, -1):
        level.write.mode("overwrite").parquet(f"{path}/level={at}")
        level = leaves.sparkSession.read.parquet(f"{path}/level={at}").groupBy(F.substring("place", 1, at - 1).alias("up")).agg(_digest(["place", "digest"], "digest"), F.sum("sites").alias("sites")).withColumnRenamed("up", "place") if at else level


def root(spark: SparkSession, path: str) -> str | None:
    """Digest of the whole tree; null of an empty one."""
    first = spark.read.parquet(f"{path}/level=0").first()
    return first.digest if first else None


def differing_places(spark: SparkSession, a: str, b: str, depth: int = DEPTH) -> DataFrame:
    """(place): lowest nodes that differ or that only one tree has."""
    differ = None
    for at in range(depth + 1):
        sides = [spark.read.parquet(f"{p}/level={at}").select("place", F.col("digest").alias(n)) for p, n in ((a, "_a"), (b, "_b"))]
        if differ is not None:
            sides = [s.join(differ.withColumnRenamed("place", "_up"), F.substring("place", 1, at - 1) == F.col("_up"), "left_semi") for s in sides]
        differ = sides[0].join(sides[1], "place", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("place")
    return differ


def differences(spark: SparkSession, a: str, b: str, depth: int = DEPTH) -> DataFrame:
    """(domain, change): ``added`` where only ``b`` has it, ``removed`` where only ``a`` has it, else ``changed``."""
    from .graph import written

    differ = written(differing_places(spark, a, b, depth), "places")
    tops = [r.top for r in differ.select(F.substring("place", 1, TOP).alias("top")).distinct().collect()]  # 256 at most
    sides = [spark.read.schema("domain string, digest string, place string, top string").parquet(f"{p}/leaves").where(F.col("top").isin(tops)).join(differ, "place", "left_semi").select("domain", F.col("digest").alias(n)) for p, n in ((a, "_a"), (b, "_b"))]
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return sides[0].join(sides[1], "domain", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("domain", change.alias("change"))
