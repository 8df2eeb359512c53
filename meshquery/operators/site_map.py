"""A site's map in one build from the layers in which its pages are known.

A page is rendered (its own address or the one it ended at), or fetched (structured data, with what packs of selectors found
beside), or known by its address only; the first of these makes its node. Requests that were found on a page
become actions of its node and fill in its action features. Edges come from links and trails of pages and from paths.

Layers, all of any number of sites (domain, url, ..):
``fetched`` (page_type, confidence 0 to 255, flags, features, completeness), ``rendered`` (final_url, page_type, confidence 0 to 1, flags, features),
``patterns`` (page_type, confidence 0 to 1, features), ``addresses``; ``requests`` (url, category, action, confidence, is_plain: a form
or a script call, not a platform's template), ``links`` (url, target), ``crumbs`` (url, position, target).

Defined results: of several rows of one address in a layer one counts, the least by its columns' order; null addresses and sites are left out; a site's
nodes are numbered from 0 by (layer, url), fetched first, and ``most`` keeps the first of them; links to unknown pages make no edge.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DIM, FEATURE_DIM, NODE_FLAGS
from ..functions import apps, urls
from ..sources.encoders import CALLS_TO_ACTION, clamp, of_address, vector
from . import graph
from .ranks import ranked
from .vector import merged_features

KEY = ["domain", "url"]


class SiteMap(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    actions: DataFrame


def _one(layer: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(domain, url, struct ``name``): one row per address."""
    known = layer.where(F.col("domain").isNotNull() & F.col("url").isNotNull())
    return known.groupBy(*KEY).agg(F.min(F.struct(*columns)).alias(name))


def _set(features: Column, values: dict[str, Column]) -> Column:
    """Features with some replaced where the value isn't null."""
    return F.transform(features, lambda v, i: F.coalesce(*[F.when(i == DIM[k], c.cast("float")) for k, c in values.items()], v))


def build(addresses: DataFrame, fetched: DataFrame, rendered: DataFrame, patterns: DataFrame, requests: DataFrame, links: DataFrame, crumbs: DataFrame, most: int | None = None) -> SiteMap:
    """Nodes (domain, node_id, url, page_type, confidence, flags, features and their counts and norm), edges (domain, src, dst, edge_type, weight, flags) and
    actions (domain, node_id, category, action, target_node, cost_hint, risk, http_executable)."""
    own = ["page_type", "confidence", "flags", "features"]
    shown = graph.written(_one(rendered.withColumn("final_url", F.coalesce("final_url", "url")), ["final_url", *own], "r"), "shown")
    had = _one(fetched, [*own, "completeness"], "f").join(_one(patterns, ["page_type", "confidence", "features"], "p"), KEY, "left")
    moved = shown.groupBy("domain", F.col("r.final_url").alias("url")).agg(F.min(F.struct("url", "r")).alias("m")).select("domain", "url", F.col("m.r").alias("moved"))
    first = graph.written(had.join(shown, KEY, "left").join(moved, KEY, "left").withColumn("r", F.coalesce("r", "moved")).drop("moved").withColumn("layer", F.lit(0)), "fetched")
    names = first.select(*KEY)
    ends = shown.select("domain", "url", F.col("r.final_url").alias("final_url"), "r")
    only = ends.join(names, KEY, "left_anti").join(names.withColumnRenamed("url", "final_url"), ["domain", "final_url"], "left_anti").select(*KEY, "r").withColumn("layer", F.lit(1))
    taken = names.unionByName(only.select(*KEY)).unionByName(only.select("domain", F.col("r.final_url").alias("url"))).distinct()
    rest = addresses.select(*KEY).where(F.col("domain").isNotNull() & F.col("url").isNotNull()).distinct().join(taken, KEY, "left_anti").withColumn("layer", F.lit(2))
    # every layer gives (page_type, confidence, flags, features) for itself, so that no plan holds the ways of all
    at = lambda c: F.floor(c * 255 + 1e-6).cast("int")
    seen = lambda rows: rows.select("layer", *KEY, F.col("r.final_url").alias("final_url"), F.col("r.page_type").cast("int").alias("page_type"), at(F.col("r.confidence")).alias("confidence"), F.col("r.flags").bitwiseOR(F.lit(NODE_FLAGS["rendered"])).cast("int").alias("flags"), F.col("r.features").alias("features"))
    surer = F.coalesce(F.col("p.confidence") * 255 > F.col("f.confidence"), F.lit(False))
    filled = F.size(F.filter("p.features", lambda v: v != 0)) / float(FEATURE_DIM)
    merged = F.when(F.col("p").isNull(), F.col("f.features")).otherwise(merged_features(F.col("p.features"), F.col("f.features"), filled, F.col("f.completeness")))
    read = first.where("r IS NULL").select(
        "layer", *KEY, F.lit(None).cast("string").alias("final_url"), F.when(surer, F.col("p.page_type")).otherwise(F.col("f.page_type")).cast("int").alias("page_type"), F.when(surer, at(F.col("p.confidence"))).otherwise(F.col("f.confidence")).cast("int").alias("confidence"),
        F.col("f.flags").bitwiseAND(F.lit(~NODE_FLAGS["rendered"] & 255)).cast("int").alias("flags"), merged.alias("features"),
    )
    named = rest.withColumn("a", urls.classify(F.col("url")))
    told = vector({k: v for k, v in of_address(F.col("url"), F.col("a")).items() if not k.startswith("url_")})
    guessed = named.select("layer", *KEY, F.lit(None).cast("string").alias("final_url"), F.col("a.page_type").cast("int").alias("page_type"), at(F.col("a.confidence")).alias("confidence"), F.lit(NODE_FLAGS["estimated"]).alias("flags"), told.alias("features"))
    nodes = ranked(seen(first.where("r IS NOT NULL")).unionByName(seen(only)).unionByName(read).unionByName(guessed), ["domain"], [F.asc("layer"), F.asc("url")], "node_id")
    if most is not None:
        nodes = nodes.where(F.col("node_id") < most)
    nodes = graph.written(nodes.drop("layer").withColumn("node_id", F.col("node_id").cast("int")), "nodes")

    risk = F.least(F.floor((1 - F.col("confidence")) * 3 + 1e-9), F.lit(3))
    acts = requests.join(nodes.select("domain", "url", "node_id"), KEY)
    actions = acts.select("domain", "node_id", "category", "action", F.lit(-2).alias("target_node"), F.lit(0).alias("cost_hint"), risk.cast("int").alias("risk"), F.lit(True).alias("http_executable"))
    sums = acts.groupBy("domain", "node_id").agg(F.count("*").alias("n"), (F.count_if("is_plain") / F.count("*")).alias("plain"), F.max(F.col("category").isin(*CALLS_TO_ACTION).cast("int")).alias("called"))
    f = F.col("features")
    has, root = F.col("n").isNotNull(), F.col("node_id") == 0
    cautious = F.when(has, 1 - F.col("plain")).otherwise(f[DIM["cautious_action_ratio"]].cast("double"))
    filled = _set(f, {
        "action_count": F.when(has, clamp((F.floor(f[DIM["action_count"]].cast("double") * 20 + 1e-6) + F.col("n")) / 20.0)), "safe_action_ratio": F.col("plain"),
        "cautious_action_ratio": F.when(root & apps.known_drag(F.col("domain")) & (cautious < 0.01), F.lit(0.1)).otherwise(cautious), "primary_cta_present": F.when(F.col("called") == 1, F.lit(1.0)),
        "auth_required_ratio": F.when(root & apps.known_sockets(F.col("domain")), F.lit(0.1)),
    })
    done = graph.dealt_by(nodes, "domain", "node_id").join(sums, ["domain", "node_id"], "left").withColumn("features", filled).drop("n", "plain", "called", "final_url")

    places = nodes.select("domain", "url", "node_id").unionByName(nodes.where("final_url IS NOT NULL AND final_url <> url").select("domain", F.col("final_url").alias("url"), "node_id")).groupBy(*KEY).agg(F.min("node_id").alias("node_id"))
    sources = lambda rows: rows.join(places.withColumnRenamed("node_id", "src"), KEY).select("domain", "src", F.col("target").alias("url"), *[c for c in rows.columns if c == "position"])
    linked = graph.link_edges(sources(links), places)
    trail = sources(crumbs).join(places, KEY).select("domain", F.col("src").alias("page"), "position", "node_id")
    every_edge = linked.unionByName(graph.crumb_edges(trail)).unionByName(graph.path_edges(nodes.select("domain", "node_id", "url")))
    edges = graph.written(every_edge.groupBy("domain", "src", "dst", "edge_type").agg(F.min("weight").alias("weight")).withColumn("flags", F.lit(0)), "edges")
    return SiteMap(graph.built(done, edges), edges, actions)
