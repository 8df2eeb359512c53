"""Ranks within groups of any size. Rows are range-sorted by (keys, order) and numbered where they lie; a group's rows are one run
in each partition it reaches, so its count per partition and the first number there give every rank. No group is one
task's input, however large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` long, 0, 1, .. in ``order`` within each group of ``keys``; rows that ``order`` can't tell apart are
    numbered freely. Null keys are a group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loose = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.asc(k) for k in keys], *order, F.asc("_tie")]
    lain = written(loose.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33)
    runs = lain.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    bases = runs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_own"), (before - F.col("_first")).alias("_base"))
    same = part == F.col("_own")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return lain.join(bases, same).select(*df.columns, (F.col("_at") + F.col("_base")).alias(name))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group."""
    return ranked(df, keys, order, "_rank").where(F.col("_rank") < n).drop("_rank")
