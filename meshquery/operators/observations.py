"""Logs of observations: (id, ts, session_id, labels array, embedding, memory_link, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vector

SCHEMA = (
    "id bigint, ts timestamp, session_id int, source struct<type:string,path:string,mime:string,region:struct<x:int,y:int,w:int,h:int>>, embedding array<float>, "
    "thumbnail binary, meta struct<width:int,height:int,original_width:int,original_height:int,labels:array<string>,description:string>, memory_link bigint"
)


def query(rows: DataFrame, sessions: list[int] | None = None, after=None, before=None, labels: list[str] | None = None, limit: int = 20, labels_col: str = "labels") -> DataFrame:
    """Observations of some sessions, within inclusive times, with any of the labels; the first by id."""
    if sessions:
        rows = rows.where(F.col("session_id").isin(sessions))
    if after is not None:
        rows = rows.where(F.col("ts") >= F.lit(after))
    if before is not None:
        rows = rows.where(F.col("ts") <= F.lit(before))
    if labels:
        rows = rows.where(F.arrays_overlap(labels_col, F.array(*[F.lit(x) for x in labels])))
    return rows.orderBy("id").limit(limit)


def by_session(rows: DataFrame, session: int) -> DataFrame:
    return rows.where(F.col("session_id") == session).orderBy("id")


def in_range(rows: DataFrame, start, end) -> DataFrame:
    return rows.where(F.col("ts").between(F.lit(start), F.lit(end))).orderBy("id")


def recent(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def similar(rows: DataFrame, target: list[float], k: int = 10, least: float = 0.7) -> DataFrame:
    return vector.nearest(rows, target, k, "embedding", ("id",), least)


def similar_to(rows: DataFrame, observation: int, k: int = 10, least: float = 0.7) -> DataFrame:
    return vector.similar_to(rows, "id", observation, k, "embedding", least)


def linked(rows: DataFrame, observation: int, memory: int) -> DataFrame:
    return rows.withColumn("memory_link", F.when(F.col("id") == observation, F.lit(memory)).otherwise(F.col("memory_link")))


def tracked(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Consecutive captures of a session that are less alike than ``least``: (session_id, id, before, similarity)."""
    w = W.partitionBy("session_id").orderBy("ts", "id")
    pairs = rows.withColumn("_e", F.lag("embedding").over(w)).withColumn("before", F.lag("id").over(w)).where("before is not null")
    return pairs.withColumn("similarity", vector.cosine(F.col("embedding"), F.col("_e"))).where(F.col("similarity") < least).select("session_id", "id", "before", "similarity")


def sessions(rows: DataFrame) -> DataFrame:
    """(session_id, n, first, last): timelines."""
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def stats(rows: DataFrame) -> DataFrame:
    """One row: observations, sessions, width of the embeddings, next free id."""
    return rows.agg(F.count("*").alias("observations"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
