"""Differences of two snapshots, their application, privacy, registry of snapshots and deltas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..catalog import NODE_FLAGS

CHANGED = 0.001
# Dimensions that a shared snapshot must not carry.
PRIVATE = (88, 89, *range(112, 128))


def node_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("domain", "url"), vector: str = "features") -> DataFrame:
    """(keys, op, dims map<int,float>): pages added (known dims), removed, and modified (dims changed by over 0.001).
    One full outer join on the page key."""
    both = old.select(*keys, F.col(vector).alias("_old")).join(new.select(*keys, F.col(vector).alias("_new")), list(keys), "full_outer")
    places = F.sequence(F.lit(0), F.size(F.coalesce("_new", "_old")) - 1)
    moved = F.filter(F.transform(places, lambda i: F.struct(i.alias("dim"), F.get("_new", i).alias("v"), F.get("_old", i).alias("o"))), lambda x: F.abs(x["v"] - x["o"]) > CHANGED)
    known = F.filter(F.transform(places, lambda i: F.struct(i.alias("dim"), F.get("_new", i).alias("v"), F.get("_new", i).alias("o"))), lambda x: x["v"] != 0)
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(F.size(moved) > 0, "modify")
    dims = F.when(F.col("_old").isNull(), known).when(F.col("_new").isNotNull(), moved)
    return both.withColumn("op", op).where("op is not null").withColumn("_d", dims).select(*keys, "op", F.map_from_arrays(F.coalesce(F.col("_d.dim"), F.array().cast("array<int>")), F.coalesce(F.col("_d.v"), F.array().cast("array<float>"))).alias("dims"))


def edge_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("domain", "src", "dst")) -> DataFrame:
    """(keys, op): edges added and removed, as sets; one aggregation over both."""
    seen = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    return seen.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n").select(*keys, F.when(F.col("n") == 1, "edge_add").otherwise("edge_remove").alias("op"))


def column_delta(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], closer_than: float = CHANGED) -> DataFrame:
    """(keys, op, field, old_value, new_value) of tables with named value columns."""
    both = old.select(*keys, F.lit(True).alias("_in_old"), *[F.col(v).alias(f"_o_{v}") for v in values]).join(new.select(*keys, F.lit(True).alias("_in_new"), *[F.col(v).alias(f"_n_{v}") for v in values]), keys, "full_outer")
    op = F.when(F.col("_in_old").isNull(), "add").when(F.col("_in_new").isNull(), "remove").otherwise("modify")
    each = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"_o_{v}").cast("double").alias("old_value"), F.col(f"_n_{v}").cast("double").alias("new_value")) for v in values])
    long = both.select(*keys, op.alias("op"), F.explode(each).alias("x")).select(*keys, "op", "x.*")
    return long.where((F.col("op") != "modify") | (F.abs(F.col("new_value") - F.col("old_value")) > closer_than) | (F.col("new_value").isNull() != F.col("old_value").isNull()))


def apply_delta(old: DataFrame, delta: DataFrame, keys: tuple[str, ...] = ("domain", "url"), vector: str = "features", width: int = 128) -> DataFrame:
    """The old snapshot after a delta: removed pages go, new ones come with their known dims, changed dims are replaced."""
    joined = old.withColumn("_had", F.lit(True)).join(delta, list(keys), "full_outer").where("op is null or op <> 'remove'")
    base = F.coalesce(F.col(vector), F.array_repeat(F.lit(0.0).cast("float"), width))
    patched = F.transform(base, lambda v, i: F.coalesce(F.try_element_at("dims", i), v))
    return joined.withColumn(vector, F.when(F.col("op").isNull(), F.col(vector)).otherwise(patched)).select(*old.columns)


def changed_dims(pairs: DataFrame, dims: list[int], threshold: float, old: str = "old", new: str = "new") -> DataFrame:
    """Rows (.., changes array<struct<dim, old, new>>) where a watched dimension moved by over ``threshold``."""
    watched = F.filter(F.transform(F.array(*[F.lit(d) for d in dims]), lambda d: F.struct(d.alias("dim"), F.get(old, d).alias("old"), F.get(new, d).alias("new"))), lambda x: F.abs(x["new"] - x["old"]) > threshold)
    return pairs.withColumn("changes", watched).where(F.size("changes") > 0)


def feature_hash(vector: Column) -> Column:
    return F.xxhash64(vector)


def snapshot_hash(nodes: DataFrame) -> DataFrame:
    """(domain, digest): order-free digest of each site's pages."""
    return nodes.groupBy("domain").agg(F.sum(F.xxhash64("url", "features").cast("decimal(38,0)")).alias("_h"), F.count("*").alias("_n")).select("domain", F.sha2(F.concat_ws(":", F.col("_h").cast("string"), F.col("_n").cast("string")), 256).alias("digest"))


def differing_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites whose digests differ or that only one side has."""
    return a.select("domain", F.col("digest").alias("_a")).join(b.select("domain", F.col("digest").alias("_b")), "domain", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("domain")


def stripped(nodes: DataFrame, vector: str = "features") -> DataFrame:
    """Private dimensions zeroed, and all dimensions of pages behind a login."""
    hidden = F.col("flags").bitwiseAND(NODE_FLAGS["auth_required"]) != 0
    clean = F.transform(vector, lambda v, i: F.when(hidden | i.isin(list(PRIVATE)), F.lit(0.0).cast("float")).otherwise(v))
    return nodes.withColumn(vector, clean)


#: Files a push writes for a site at most.
FILES = 8


class Registry:
    """Snapshots and deltas of many sites as partitioned Parquet under one folder; partition listing is the index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def push(self, nodes: DataFrame, delta: DataFrame | None = None) -> None:
        """Replaces the snapshots of the sites in ``nodes`` and appends their delta. A site goes to at most FILES files."""
        told = lambda df: [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
        dealt = lambda df: df.repartition("domain", F.pmod(F.xxhash64(*told(df)), F.lit(FILES)))
        dealt(nodes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(f"{self.path}/snapshots")
        if delta is not None:
            dealt(delta).write.mode("append").partitionBy("domain").parquet(f"{self.path}/deltas")

    def pull(self, domain: str | None = None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/snapshots")
        return out if domain is None else out.where(F.col("domain") == domain)

    def deltas_since(self, domain: str, since) -> DataFrame:
        """Deltas strictly after ``since``."""
        return self.spark.read.parquet(f"{self.path}/deltas").where((F.col("domain") == domain) & (F.col("ts") > F.lit(since))).orderBy("ts")

    def sites(self) -> DataFrame:
        return self.pull().groupBy("domain").agg(F.count("*").alias("nodes"))

    def stats(self) -> DataFrame:
        """(domain, nodes, bytes, deltas): pages, size of the stored snapshot and number of deltas of each site. Sizes come from
        the listing of files; no file is opened for them."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/snapshots")
        sizes = files.groupBy("domain").agg(F.sum("length").alias("bytes"))
        out = self.sites().join(sizes, "domain")
        try:
            deltas = self.spark.read.parquet(f"{self.path}/deltas").groupBy("domain").agg(F.count("*").alias("deltas"))
        except AnalysisException:  # none pushed yet
            return out.withColumn("deltas", F.lit(0).cast("long"))
        return out.join(deltas, "domain", "left").withColumn("deltas", F.coalesce("deltas", F.lit(0).cast("long")))


def maintained(rows: DataFrame, keys: list[str], keep: int, now, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """One row: what a maintenance run finds, lets expire, collects beyond the newest ``keep`` of a key, and leaves."""
    fresh = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")) <= ttl_seconds
    counts = rows.groupBy(*keys).agg(F.count("*").alias("all"), F.count_if(fresh).alias("fresh"))
    left = F.sum(F.least("fresh", F.lit(keep)))
    return counts.agg(F.sum("all").alias("entries"), F.sum(F.col("all") - F.col("fresh")).alias("expired"), (F.sum("fresh") - left).alias("collected"), left.alias("left"))


def keep_last(rows: DataFrame, keys: list[str], n: int, ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows per key (garbage collection); Spark limits groups before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties])
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def unexpired(rows: DataFrame, now, ttl_seconds: int, ts: str = "cached_at") -> DataFrame:
    return rows.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")) <= ttl_seconds)


def least_recent(rows: DataFrame, keep: int, ts: str = "used_at") -> DataFrame:
    """What a cache of ``keep`` entries evicts."""
    kept = rows.orderBy(F.col(ts).desc(), "domain").limit(keep)
    return rows.join(kept.select("domain"), "domain", "left_anti")
