"""Query results as text: JSON lines and aligned columns, row by row on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def text_rows(df: DataFrame, gap: str = "  ") -> DataFrame:
    """(value): each row as a line of left-aligned columns as wide as their widest value or name; the widths are one small aggregate."""
    said = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(c) for c in df.columns])
    widest = said.agg(*[F.greatest(F.max(F.length(f"`{c}`")), F.lit(len(c))).alias(c) for c in df.columns]).first()
    widths = {c: widest[c] or len(c) for c in df.columns}
    return said.select(F.rtrim(F.concat_ws(gap, *[F.rpad(F.col(f"`{c}`"), widths[c], " ") for c in df.columns])).alias("value"))


def save_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.text(path)


def save_text(df: DataFrame, path: str) -> None:
    text_rows(df).write.text(path)
