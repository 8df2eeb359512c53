"""Site graphs: node filters, shortest paths, clustering, building edges, degrees, relationships."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import EDGE_FLAGS, EDGE_TYPE, NODE_FLAGS, PAGE_TYPE
from ..functions import urls

FLAG_MAX = 65_535


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, in a temporary folder, which only a
    single-machine session may have."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="meshquery-"))
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder, where its lineage ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as ``bucketed`` keeps buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """``written``, for a table that many rounds join by the same keys: in buckets by them, so that no round shuffles it, and sorted, so that a
    range of the first key leaves out the blocks that don't hold it. Rows should be dealt by the keys (``dealt_by``). Its name leaves the catalog at once."""
    spark = df.sparkSession
    n, label = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    # A write to buckets sorts by the bucket's number first, which it works out anew for both rows of each comparison: rows that are in order already take one
    # comparison each. Planned writes would drop the sort before theirs.
    with _set(spark, "spark.sql.optimizer.plannedWrite.enabled", "false"):
        df.sortWithinPartitions(*keys).write.format("parquet").option("path", shared_path(spark, name)).bucketBy(n, *keys).sortBy(*keys).saveAsTable(label)
    found = spark.table(label)
    spark.sql(f"DROP TABLE {label}")
    return found


@contextmanager
def _set(spark: SparkSession, setting: str, value: str):
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def in_order(spark: SparkSession):
    """Within, a scan of ``bucketed`` tells Spark that its buckets are sorted, so that no round sorts them again."""
    return _set(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def filter_nodes(
    nodes: DataFrame,
    page_types: list[str] | None = None,
    ranges: list[tuple[int, float | None, float | None]] = (),
    require: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    sort: tuple[int, bool] | None = None,
    limit: int = 0,
) -> DataFrame:
    """Nodes of some types whose features lie in inclusive ranges (dim, low, high) and whose flags fit; with
    ``confidence_share`` (0..1) and ``key_features`` (the dims asked about). Sort: (dim, descending); limit 0: all."""
    out = nodes
    if page_types:
        out = out.where(F.col("page_type").isin([PAGE_TYPE[t] for t in page_types]))
    for dim, low, high in ranges:
        if dim < 128:
            value = F.get("features", F.lit(dim))
            # Bounds are single precision, like the features.
            out = out.where((value >= F.lit(low).cast("float")) if low is not None else F.lit(True)).where((value <= F.lit(high).cast("float")) if high is not None else F.lit(True))
    must, never = sum(NODE_FLAGS[f] for f in require), sum(NODE_FLAGS[f] for f in exclude)
    if must:
        out = out.where(F.col("flags").bitwiseAND(must) == must)
    if never:
        out = out.where(F.col("flags").bitwiseAND(never) == 0)
    keys = [x for dim, _, _ in ranges if dim < 128 for x in (F.lit(dim), F.get("features", F.lit(dim)))]
    out = out.withColumn("confidence_share", F.col("confidence") / 255.0)
    out = out.withColumn("key_features", F.create_map(*keys) if keys else F.create_map().cast("map<int,float>"))
    if sort:
        value = F.get("features", F.lit(sort[0]))
        out = out.orderBy(value.desc_nulls_last() if sort[1] else value.asc_nulls_last(), "domain", "node_id")
    elif limit:
        out = out.orderBy("domain", "node_id")
    return out.limit(limit) if limit else out


def parse_filter(text: str) -> tuple[int, float | None, float | None]:
    """``48<300`` or ``52>0.8`` as a range."""
    for sign in ("<", ">"):
        dim, found, value = text.partition(sign)
        if found:
            return (int(dim), None, float(value)) if sign == "<" else (int(dim), float(value), None)
    raise ValueError(f"not a filter: {text!r}")


def merged_sites(found: DataFrame, per_site: int, limit: int) -> DataFrame:
    """The best nodes of all sites by confidence; at most ``per_site`` of each site first (0: no limit)."""
    if per_site:
        w = W.partitionBy("domain").orderBy(F.desc("confidence"), "node_id")
        found = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_site).drop("_rank")
    return found.orderBy(F.desc("confidence"), "domain", "node_id").limit(limit)


def cost_of(mode: str):
    """Edge cost: ``weight``, ``hops`` or ``state_changes``."""
    changes = F.col("flags").bitwiseAND(EDGE_FLAGS["changes_state"]) != 0
    return {"weight": F.col("weight").cast("long"), "hops": F.lit(1).cast("long"), "state_changes": F.when(changes, 10).otherwise(1).cast("long")}[mode]


def shortest_paths(edges: DataFrame, source: int, target: int | None = None, mode: str = "weight", avoid: tuple[str, ...] = (), domain: str | None = None) -> DataFrame:
    """(node, cost, path) from ``source``: frontier relaxation in rounds. A round joins only the nodes that got cheaper
    with the edges; it ends when nothing improves or, with a target, when no frontier node is below the target's cost.
    Ties go to the smaller path."""
    spark = edges.sparkSession
    if domain is not None:
        edges = edges.where(F.col("domain") == domain)
    for flag in avoid:
        edges = edges.where(F.col("flags").bitwiseAND(EDGE_FLAGS[flag]) == 0)
    steps = dealt_by(edges.select("src", "dst", cost_of(mode).alias("step")), "src").groupBy("src", "dst").agg(F.min("step").alias("step"))
    steps = bucketed(steps, ("src",), "steps")
    # One table: a node's best so far and the round that found it; of equal costs the earlier round's, then the smaller path.
    best = spark.range(1).select(F.lit(source).cast("int").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("round"), F.array(F.lit(source).cast("int")).alias("path"))
    turn, limit = 0, None
    with in_order(spark):
        while True:
            front = best.where(F.col("round") == turn)
            if target is not None:
                limit = best.where(F.col("node") == target).agg(F.min("cost")).first()[0]
            if limit is not None:
                front = front.where(F.col("cost") < limit)
            low, high = front.agg(F.min("node"), F.max("node")).first()
            if low is None:
                break
            turn += 1
            reach = front.join(steps.where(F.col("src").between(low, high)), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(turn).alias("round"), F.concat("path", F.array("dst")).alias("path"))
            best = written(best.unionByName(reach).groupBy("node").agg(F.min(F.struct("cost", "round", "path")).alias("m")).select("node", "m.*"), "best")
    best = best.drop("round")
    return best if target is None else best.where(F.col("node") == target)


def cluster_count(n: int) -> int:
    return max(1, n // 3) if n < 30 else max(3, int((n / 10) ** 0.5))


def _at_even_places(keys: DataFrame, n: int, k: int) -> DataFrame:
    """The keys at places i * n // k (i < k) of their order: a range sort, and one offset per partition."""
    rows = keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id())
    rows = written(rows, "ordered").withColumn("piece", F.shiftright("id", 33))
    pieces = rows.groupBy("piece").agg(F.count("*").alias("n"))
    bases = pieces.select("piece", (F.sum("n").over(W.orderBy("piece")) - F.col("n")).alias("base"))  # a row per partition
    at = F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1)
    turn = F.floor((at * k + (n - 1)) / F.lit(n))
    return rows.join(F.broadcast(bases), "piece").where((F.floor(turn * n / F.lit(k)) == at) & (turn < k)).select("key")


def kmeans(rows: DataFrame, key: str, vector: str, k: int | None = None, rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster), centroids): Lloyd's rounds from rows at even places in key order, squared Euclidean distance,
    ties to the lower cluster; an empty cluster stays. Centroids (k x width) travel with the tasks; a task sends back
    one sum per cluster."""
    data = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = data.count()
    if not n:
        return data.select(F.col("key").alias(key), F.lit(0).alias("cluster")), np.zeros((0, 0))
    k = k or cluster_count(n)
    first = data.join(F.broadcast(_at_even_places(data.select("key"), n, k)), "key").orderBy("key").toPandas()  # k rows
    centres = np.stack(first.v)

    def near(pdf: pd.DataFrame, c: np.ndarray) -> np.ndarray:
        x = np.stack(pdf.v)
        return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)

    for _ in range(rounds):
        c = centres

        def sums(batches, c=c):
            total, count = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    own = near(pdf, c)
                    np.add.at(total, own, np.stack(pdf.v))
                    count += np.bincount(own, minlength=len(c))
            yield pd.DataFrame({"cluster": range(len(c)), "total": list(total), "n": count})

        got = data.mapInPandas(sums, "cluster int, total array<double>, n long").where("n > 0").select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("col").alias("total"), F.sum("n").alias("n")).toPandas()
        centres = c.copy()
        if len(got):
            centres[got.cluster, got.pos] = got.total / got.n
        if np.allclose(centres, c, rtol=0, atol=1e-12):
            break
    final = centres

    def label(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf.key, "cluster": near(pdf, final).astype(np.int32)})

    return data.mapInPandas(label, f"`{key}` {rows.schema[key].dataType.simpleString()}, cluster int"), centres


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): element-wise means."""
    long = rows.select(group, F.posexplode(vector)).groupBy(group, "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("centroid"))


def cluster_types(nodes: DataFrame, clusters: DataFrame, key: str = "node_id") -> DataFrame:
    """(cluster, page_type): the most frequent type, the smaller on ties."""
    counts = clusters.join(nodes.select(key, "page_type"), key).groupBy("cluster", "page_type").count()
    return counts.groupBy("cluster").agg(F.max(F.struct("count", (-F.col("page_type")).alias("neg"))).alias("m")).select("cluster", (-F.col("m.neg")).alias("page_type"))


def degrees(edges: DataFrame) -> DataFrame:
    """(domain, node_id, inbound, outbound), at most 65535 each; one shuffle."""
    ends = edges.select("domain", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("domain", F.col("e.node_id").alias("node_id")).agg(F.least(F.sum("e.i"), F.lit(FLAG_MAX)).alias("inbound"), F.least(F.sum("e.o"), F.lit(FLAG_MAX)).alias("outbound"))


def built(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with inbound and outbound counts and the length of their feature vector filled in."""
    counts = degrees(edges)
    joined = nodes.drop("inbound_count", "outbound_count", "feature_norm").join(counts, ["domain", "node_id"], "left")
    size = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return joined.withColumn("inbound_count", F.coalesce("inbound", F.lit(0))).withColumn("outbound_count", F.coalesce("outbound", F.lit(0))).withColumn("feature_norm", size.cast("float")).drop("inbound", "outbound")


def edges_from(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node)


def updated(nodes: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("domain", "node_id")) -> DataFrame:
    """Upsert: columns of ``changes`` replace those of equal key where not null; new keys are added."""
    new = [c for c in changes.columns if c not in keys]
    joined = nodes.join(changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new]), list(keys), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns])


def with_flags(nodes: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("domain", "node_id")) -> DataFrame:
    """Nodes whose flags have those of ``changes`` (keys, flags) added, bit by bit; unknown keys change nothing."""
    more = changes.groupBy(*keys).agg(F.bit_or("flags").alias("_more"))
    joined = nodes.join(more, list(keys), "left")
    return joined.withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_more", F.lit(0)))).drop("_more").select(*nodes.columns)


def link_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of (domain, src, url) links to known pages, self-links dropped: forward of cost 1 and back of cost 2."""
    met = links.join(nodes.select("domain", "url", F.col("node_id").alias("dst")), ["domain", "url"]).where("src <> dst").select("domain", "src", "dst").distinct()
    kind = F.lit(EDGE_TYPE["content_link"]).alias("edge_type")
    return met.select("domain", "src", "dst", kind, F.lit(1).alias("weight")).unionByName(met.select("domain", F.col("dst").alias("src"), F.col("src").alias("dst"), kind, F.lit(2).alias("weight")))


def path_edges(nodes: DataFrame) -> DataFrame:
    """Edges told by URLs: root to all (2, back 3), parent path to child (2, back 3), a ring of siblings (1) for families of
    2 to 100, the first 20 of them. The parent join is an equi-join on the normalised path."""
    own = nodes.select("domain", "node_id", F.regexp_replace(urls.path(F.col("url")), r"(?<=.)/+$", "").alias("path")).withColumn("parent", urls.parent_path(F.concat(F.lit("x://h"), "path")))
    root = own.where("path = '/'").groupBy("domain").agg(F.min("node_id").alias("root"))
    tree = own.where("path <> '/'").join(root, "domain").select("domain", F.col("root").alias("src"), F.col("node_id").alias("dst"))
    parents = own.select("domain", F.col("path").alias("parent"), F.col("node_id").alias("src"))
    tree = tree.unionByName(own.where("parent <> '/'").join(parents, ["domain", "parent"]).where("src <> node_id").select("domain", "src", F.col("node_id").alias("dst"))).distinct()
    down = tree.select("domain", "src", "dst", F.lit(2).alias("weight"))
    up = tree.select("domain", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(3).alias("weight"))
    order = W.partitionBy("domain", "parent").orderBy("node_id")
    families = own.where("path <> '/'").groupBy("domain", "parent").agg(F.count("*").alias("n")).where("n between 2 and 100").drop("n")
    ring = own.where("path <> '/'").join(families, ["domain", "parent"], "left_semi").withColumn("at", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("node_id").over(order), F.first("node_id").over(order))).where("at <= 20")
    side = ring.where("node_id <> next").select("domain", F.col("node_id").alias("src"), F.col("next").alias("dst"), F.lit(1).alias("weight"))
    kind = F.lit(EDGE_TYPE["navigation"]).alias("edge_type")
    return down.unionByName(up).unionByName(side).groupBy("domain", "src", "dst").agg(F.min("weight").alias("weight")).select("domain", "src", "dst", kind, "weight")


def crumb_edges(crumbs: DataFrame) -> DataFrame:
    """Each breadcrumb to the next: (domain, page, position, node_id) rows; of one position, by node_id."""
    w = W.partitionBy("domain", "page").orderBy("position", "node_id")
    return crumbs.withColumn("src", F.lag("node_id").over(w)).where("src is not null and src <> node_id").select("domain", "src", F.col("node_id").alias("dst"), F.lit(EDGE_TYPE["breadcrumb"]).alias("edge_type"), F.lit(1).alias("weight")).distinct()


def diverse_sample(nodes: DataFrame, n: int, by: str = "page_type") -> DataFrame:
    """Round-robin over groups: everyone's first row, then everyone's second, up to n. Up to a thousand, Spark keeps n rows of each group
    before they move; beyond, rows are ranked by a range sort. No group is one task's input either way."""
    from .ranks import ranked

    if n <= 1000:
        turns = nodes.withColumn("_turn", F.row_number().over(W.partitionBy(by).orderBy("node_id"))).where(F.col("_turn") <= n)
    else:
        turns = ranked(nodes, [by], [F.asc("node_id")], "_turn").where(F.col("_turn") < n)
    return turns.orderBy("_turn", by, "node_id").limit(n).drop("_turn")


def render_order(nodes: DataFrame, n: int) -> DataFrame:
    """Unrendered pages worth rendering next: 2 x inbound + 10 / (1 + extra path depth) + 5 for types with under two rendered."""
    rendered = F.col("flags").bitwiseAND(NODE_FLAGS["rendered"]) != 0
    seen = nodes.groupBy("domain", "page_type").agg(F.count_if(rendered).alias("_seen"))
    slashes = F.length(F.regexp_replace("url", "[^/]", ""))
    score = 2 * F.col("inbound_count") + 10.0 / (1 + F.greatest(F.lit(0), slashes - 2)) + F.when(F.col("_seen") < 2, 5).otherwise(0)
    return nodes.where(~rendered).join(seen, ["domain", "page_type"]).withColumn("priority", score).orderBy(F.desc("priority"), "domain", "node_id").limit(n).select(*nodes.columns, "priority")


def refresh_set(nodes: DataFrame, ids: list[int] | None = None, clusters: tuple[DataFrame, int] | None = None, below: float | None = None) -> DataFrame:
    """Which nodes to refresh: those named, else a cluster's, else the stale ones, else all."""
    if ids is not None:
        return nodes.where(F.col("node_id").isin(ids))
    if clusters is not None:
        return nodes.join(clusters[0].where(F.col("cluster") == clusters[1]), "node_id", "left_semi")
    return nodes if below is None else nodes.where(F.col("freshness") / 255.0 < below)


def relationships(nodes: DataFrame, edges: DataFrame, model: str = "model") -> DataFrame:
    """(from_model, to_model, name, cardinality, edge_count) told by the links between models; two-level aggregation.
    Links within a model count only if they are of type related."""
    side = lambda a: nodes.where(F.col(model).isNotNull()).select("domain", F.col("node_id").alias(a), F.col(model).alias(f"{a}_model"))
    met = edges.select("domain", "src", "dst", "edge_type").join(side("src"), ["domain", "src"]).join(side("dst"), ["domain", "dst"])
    met = met.where((F.col("src_model") != F.col("dst_model")) | (F.col("edge_type") == EDGE_TYPE["related"]))
    links = F.count_if(F.col("edge_type") == EDGE_TYPE["related"])
    per_node = met.groupBy("src_model", "dst_model", "domain", "src").agg(F.count("*").alias("count"), links.alias("links"))
    out = written(per_node.groupBy("src_model", "dst_model").agg(F.avg("count").alias("mean"), F.max("count").alias("most"), F.sum("count").alias("edge_count"), (F.sum("links") > 0).alias("related")), "relations")
    back = out.select(F.col("dst_model").alias("src_model"), F.col("src_model").alias("dst_model"), F.col("edge_count").alias("back"))
    joined = out.join(back, ["src_model", "dst_model"], "left")
    kind = (
        F.when(F.col("src_model") == F.col("dst_model"), "many_to_many")
        .when((F.col("mean") <= 1.2) & (F.col("most") <= 2), "belongs_to")
        .when((F.coalesce("back", F.lit(0)) > 0) & (F.col("mean") > 2), "many_to_many")
        .when(F.col("most") == 1, "has_one")
        .otherwise("has_many")
    )
    # Names of well-known pairs.
    known = {"Product>Category": "belongs_to_category", "Product>Product": "similar_to", "Product>Review": "has_reviews", "Article>Article": "related_articles", "Review>Product": "reviews_product"}
    snake = F.lower(F.regexp_replace("dst_model", r"(?<!^)(\p{Lu})", "_$1"))
    plain = (
        F.when(F.col("cardinality") == "belongs_to", F.concat(F.lit("belongs_to_"), snake))
        .when(F.col("cardinality") == "has_many", F.concat(F.lit("has_"), snake, F.lit("s")))
        .when(F.col("cardinality") == "has_one", F.concat(F.lit("has_"), snake))
        .when(F.col("related"), F.concat(F.lit("related_"), snake, F.lit("s")))
        .otherwise(F.concat(snake, F.lit("s")))
    )
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    named = joined.withColumn("cardinality", kind).withColumn("name", F.coalesce(F.try_element_at(names, F.concat("src_model", F.lit(">"), "dst_model")), plain))
    return named.select(F.col("src_model").alias("from_model"), F.col("dst_model").alias("to_model"), "name", "cardinality", "edge_count").orderBy(F.desc("edge_count"), "from_model", "to_model")


class SiteGraph:
    """Nodes and edges of one or many sites with the queries callers know; everything is lazy."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, actions: DataFrame | None = None):
        self.nodes, self.edges, self.actions = nodes, edges, actions

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def filter(self, **asked) -> DataFrame:
        return filter_nodes(self.nodes, **asked)

    def nearest(self, target: list[float], k: int = 10) -> DataFrame:
        from .vector import nearest

        return nearest(self.nodes, target, k)

    def pathfind(self, source: int, target: int, **how) -> DataFrame:
        return shortest_paths(self.edges, source, target, **how)

    def clusters(self, k: int | None = None) -> DataFrame:
        return kmeans(self.nodes, "node_id", "features", k)[0]

    def node(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def actions_for(self, node_id: int) -> DataFrame:
        return self.actions.where(F.col("node_id") == node_id)
