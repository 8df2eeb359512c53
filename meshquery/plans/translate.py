"""Syntax tree to one lazy DataFrame plan.

Order: scan (domains as a partition-pruning predicate), filter, join, temporal columns, sort, limit, project. Numeric
equality is within 0.001 and written as a range, so it reaches the Parquet scan. Null (unknown) fields never match.
Sorts end in (domain, node_id), so limits are deterministic.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import timeseries
from .syntax import Compare, Logic, Null, Query, WqlError, parse, temporal

CLOSE = 0.001
IDENTITY = ("domain", "url", "node_id")


class Catalog:
    """Model name -> DataFrame of (domain, url, node_id, fields...); history: (domain, url, field, ts, value). Either may be
    a function that makes it, so that a query opens only the tables it names."""

    def __init__(self, models: dict[str, DataFrame | Callable[[], DataFrame]], history: DataFrame | Callable[[], DataFrame] | None = None, now: dt.datetime | None = None):
        self.models, self._history, self.now = models, history, now

    @property
    def history(self) -> DataFrame | None:
        return self._history() if callable(self._history) else self._history

    def model(self, name: str) -> DataFrame:
        if name not in self.models:
            raise WqlError(f"unknown model {name!r}; known: {', '.join(sorted(self.models))}")
        found = self.models[name]
        return found() if callable(found) else found


def _column(df: DataFrame, name: str, model: str) -> str:
    """A field by name, or as model.field."""
    plain = name.removeprefix(f"{model}.")
    for found in (name, plain, name.replace(".", "__"), name.split(".", 1)[-1]):
        if found in df.columns:
            return found
    raise WqlError(f"unknown field {name!r}; known: {', '.join(df.columns)}")


def condition(node, df: DataFrame, model: str) -> Column:
    if isinstance(node, Logic):
        parts = [condition(p, df, model) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    if isinstance(node, Null):
        return F.col(f"`{_column(df, node.name, model)}`").isNull()
    return compare(node, df, model)


def compare(node: Compare, df: DataFrame, model: str) -> Column:
    name = _column(df, node.name, model)
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    textual = isinstance(kind, T.StringType)
    if node.op == "like":
        return col.cast("string").like(node.value)
    if textual != isinstance(node.value, str):
        if not textual:
            return F.lit(False)  # a number never matches a text
        col = F.expr(f"try_cast(`{name}` AS double)") if node.op in ("=", "!=") else None
        if col is None:
            return F.lit(True)  # order of a text and a number is undefined: the row stays
    if isinstance(node.value, str):
        return {"=": col == node.value, "!=": col != node.value, "<": col < node.value, ">": col > node.value, "<=": col <= node.value, ">=": col >= node.value}[node.op]
    if isinstance(kind, T.BooleanType):
        col = col.cast("double")
    value = F.lit(node.value)
    if node.op == "=":
        return (col > node.value - CLOSE) & (col < node.value + CLOSE)
    if node.op == "!=":
        return (col <= node.value - CLOSE) | (col >= node.value + CLOSE)
    return {"<": col < value, ">": col > value, "<=": col <= value, ">=": col >= value}[node.op]


def _names(node) -> list[str]:
    if node is None:
        return []
    return [node.name] if isinstance(node, Compare | Null) else [n for p in node.parts for n in _names(p)]


def translate(q: Query, catalog: Catalog) -> DataFrame:
    df = catalog.model(q.model)
    if q.across:
        df = df.where(F.col("domain").isin(q.across))
    wanted = [n for n, _ in q.fields or []] + [n for n, _ in q.order] + _names(q.where)
    pseudo = {n: t for n in dict.fromkeys(wanted) if n not in df.columns and (t := temporal(n))}
    late = q.where is not None and any(n in pseudo or any(n.startswith(f"{j.model}.") for j in q.joins) for n in _names(q.where))
    if q.where is not None and not late:
        try:
            df, done = df.where(condition(q.where, df, q.model)), True
        except WqlError:
            if not q.joins:
                raise
            done = False
    else:
        done = q.where is None
    for j in q.joins:
        right = catalog.model(j.model)
        sides = (j.left, j.right)
        if j.left.startswith(f"{j.model}.") or (j.left.removeprefix(f"{q.model}.") not in df.columns):
            sides = (j.right, j.left)
        left_col, right_col = _column(df, sides[0], q.model), _column(right, sides[1], j.model)
        renamed = right.select(*[F.col(f"`{c}`").alias(c if c not in df.columns else f"{j.model}__{c}") for c in right.columns])
        key = right_col if right_col not in df.columns else f"{j.model}__{right_col}"
        df = df.join(renamed, F.col(f"`{left_col}`") == F.col(f"`{key}`"), "inner")
    if pseudo:
        df = timeseries.enrich(df, pseudo, catalog.history, catalog.now)
    if not done:
        df = df.where(condition(q.where, df, q.model))
    if q.order:
        keys = [(F.col(f"`{_column(df, n, q.model)}`").desc_nulls_last() if down else F.col(f"`{_column(df, n, q.model)}`").asc_nulls_last()) for n, down in q.order]
        df = df.orderBy(*keys, *[F.col(c) for c in ("domain", "node_id") if c not in [n for n, _ in q.order]])
    elif q.limit is not None:
        df = df.orderBy("domain", "node_id")
    if q.limit is not None:
        df = df.limit(q.limit)
    if q.fields is None:
        return df
    named = [(f"{_column(df, n, q.model)}", alias or n.split(".")[-1]) for n, alias in q.fields]
    taken = {a for _, a in named}
    return df.select(*[c for c in IDENTITY if c not in taken], *[F.col(f"`{c}`").alias(a) for c, a in named])


def wql(spark: SparkSession, text: str, catalog: Catalog) -> DataFrame:
    """Runs a query text against a catalog; lazy."""
    return translate(parse(text), catalog)
