"""Connected components of a link table, on DataFrames: minimum labels along links plus pointer jumping. Every round
ends in a table in the shared folder. A hub costs one row per link; joins on a hub are left to AQE's skew handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of (a long, b long): label is the smallest node reachable."""
    edges = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("over"), F.col("label").alias("jump"))
        labels = saved(lower.join(jump, F.col("label") == F.col("over"), "left").select("node", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        last, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if last == total:
            break
    return labels
