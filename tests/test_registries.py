"""Trees of hashes, JSON in pages, rules by longest prefix."""

import glob
import json

from pyspark.sql import functions as F

from meshquery.functions import urls
from meshquery.operators import graph, hash_tree
from meshquery.sources import json_data


def test_trees_of_two_registries(spark):
    at = [graph.shared_path(spark, "tree") for _ in range(3)]
    sites = spark.range(3000).select(F.concat(F.lit("site"), F.col("id").cast("string")).alias("domain"), F.md5(F.col("id").cast("string")).alias("digest"))
    changed = sites.where("domain <> 'site77'").withColumn("digest", F.when(F.col("domain") == "site5", "x").otherwise(F.col("digest"))).unionByName(spark.createDataFrame([("other", "y")], "domain string, digest string"))
    hash_tree.write(sites, at[0], 3)
    hash_tree.write(sites.repartition(7), at[1], 3)
    hash_tree.write(changed, at[2], 3)
    assert hash_tree.root(spark, at[0]) == hash_tree.root(spark, at[1]) != hash_tree.root(spark, at[2])
    assert hash_tree.differences(spark, at[0], at[1], 3).count() == 0
    assert sorted(map(tuple, hash_tree.differences(spark, at[0], at[2], 3).collect())) == [("other", "added"), ("site5", "changed"), ("site77", "removed")]
    assert hash_tree.differing_places(spark, at[0], at[2], 3).count() == 3
    plan = hash_tree.differences(spark, at[0], at[2], 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "top" in plan
    empty = graph.shared_path(spark, "tree")
    hash_tree.write(sites.limit(0), empty, 3)
    assert hash_tree.differences(spark, empty, at[0], 3).where("change = 'added'").count() == 3000


def test_pushes_write_few_files(spark, tmp_path):
    from meshquery.operators.delta import Registry

    nodes = spark.range(0, 4000, 1, 40).select((F.col("id") % 5).cast("string").alias("domain"), F.concat(F.lit("/"), "id").alias("url"), F.col("id").cast("int").alias("node_id"))
    Registry(spark, str(tmp_path)).push(nodes)
    assert len(glob.glob(f"{tmp_path}/snapshots/*/*.parquet")) <= 5 * 8 and spark.read.parquet(f"{tmp_path}/snapshots").count() == 4000


def test_things_of_any_nesting(spark):
    block = lambda x: f'<SCRIPT data-x type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    htmls = [
        block({"@type": "Product", "name": "A", "offers": {"price": "1.5"}}) + block("{not json") + block([{"@type": "Article"}, {"@graph": [{"@type": "Review", "name": 7}, 3]}]),
        block({"@type": ["Product", "X"], "offers": [{"lowPrice": 2}, {"price": 9}], "aggregateRating": {"ratingCount": 12}}), "<script>var x = {}</script>", None, block("[]"), block("null"), block('"text"'),
    ]
    pages = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    kinds = {}
    for r in json_data.things(pages, "i").select("i", json_data.kind_of(F.col("thing")).alias("k")).collect():
        kinds.setdefault(r.i, []).append(r.k)
    assert {i: sorted(k, key=str) for i, k in kinds.items()} == {0: sorted(["Product", "Article", None, "Review"], key=str), 1: ["Product"]}
    got = {r.i: (r.name, r.price, r.reviews) for r in json_data.products(pages, "i").collect()}
    assert got == {0: ("A", 1.5, None), 1: (None, 2.0, 12)}


def test_ten_thousand_rules_of_one_site(spark):
    rules = [("s", "disallow", f"/p{i}/") for i in range(10_000)] + [("s", "allow", "/p7/open*"), ("s", "disallow", "/exact$"), ("s", "allow", "/p9/"), ("t", "disallow", "/"), ("s", "disallow", "")]
    pages = [("s", f"https://s/p{i}/x", i >= 10_000 or i == 9) for i in range(0, 12_000, 37)] + [("s", "https://s/p7/open/1", True), ("s", "https://s/p7/shut", False), ("s", "https://s/p9/", True), ("s", "https://s/exact", False), ("s", "https://s/exactly", True), ("t", "https://t/", False), ("u", "https://u/", True), (None, None, True)]
    frame = spark.createDataFrame(pages + pages[:3], "domain string, url string, want boolean")
    out = urls.robots_allowed(frame, spark.createDataFrame(rules, "domain string, kind string, pattern string"))
    assert out.columns == ["domain", "url", "want", "allowed"] and out.count() == len(pages) + 3 and out.where("want <> allowed").count() == 0
