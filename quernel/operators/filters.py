"""The filter language (F-01 ... F-35): a small tree that compiles to one Column.

A criterion is never null: a null field is False for every operator but
IS_NULL and IS_NOT_NULL, so NOT of a null field keeps the row.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OPERATORS = (
    "EQUALS", "NOT_EQUALS", "CONTAINS", "NOT_CONTAINS", "STARTS_WITH", "ENDS_WITH", "REGEX_MATCH", "GREATER_THAN", "LESS_THAN",
    "GREATER_EQUAL", "LESS_EQUAL", "BETWEEN", "IN_LIST", "NOT_IN_LIST", "IS_NULL", "IS_NOT_NULL",
)
_COMPARE = {"GREATER_THAN": "__gt__", "LESS_THAN": "__lt__", "GREATER_EQUAL": "__ge__", "LESS_EQUAL": "__le__"}


@dataclass
class Criterion:
    """One test. ``kind``: content, metadata, similarity, temporal, quality, authority, language or custom."""

    field: str | Column
    operator: str
    value: Any = None
    kind: str = "metadata"
    case_sensitive: bool = False


@dataclass
class Group:
    """AND, OR or NOT of criteria and groups. NOT negates its first member alone; an empty group passes every row."""

    logic: str = "AND"
    members: list = field(default_factory=list)


def _column(c: Criterion, df: DataFrame) -> Column:
    names = set(df.columns)
    if isinstance(c.field, Column):
        return c.field
    if c.kind == "content":
        return F.col("content" if "content" in names else "text")
    if c.kind == "similarity":
        return F.coalesce(*(F.col(n) for n in ("similarity_score", "ranking_score") if n in names), F.lit(None).cast("double"))
    if c.kind == "temporal":
        found = [F.col(n) for n in dict.fromkeys((c.field, "created_date", "date")) if n.split(".")[0] in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")
    meta = lambda n: F.col(f"metadata.{n}") if "metadata" in names and n in df.select("metadata.*").columns else (F.col(n) if n in names else F.lit(None))
    body = F.col("content" if "content" in names else "text") if {"content", "text"} & names else F.lit("")
    if c.kind == "quality":
        return T.quality(body, meta("title").cast("string"), meta("author").cast("string"))
    if c.kind == "authority":
        return authority(meta("document_type").cast("string"), meta("source").cast("string"), meta("citation_count"))
    if c.kind == "language":
        return F.coalesce(meta("language").cast("string"), T.language(body))
    return F.col(c.field) if c.field.split(".")[0] in names else F.lit(None).cast("string")


def authority(document_type: Column, source: Column, citations: Column) -> Column:
    """X-39 / R-05: laws and regulations, official sources and citations raise it; at most 1."""
    kind, origin = F.lower(F.coalesce(document_type, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    score = F.lit(0.5) + F.when(kind.rlike("law|regulation"), 0.3).when(kind.rlike("official"), 0.2).otherwise(0.0)
    score = score + F.when(origin.rlike("official|government"), 0.2).otherwise(0.0)
    n = F.coalesce(citations.cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), score + F.when(n > 0, F.least(F.lit(0.3), F.log1p(n) / 10)).otherwise(0.0))


def _text(col: Column, c: Criterion) -> Column:
    fold = (lambda x: x) if c.case_sensitive else F.lower
    lit = lambda v: fold(F.lit(str(v)))
    a, op, v = fold(col.cast("string")), c.operator, c.value
    if op == "NOT_EQUALS":
        return a != lit(v)
    if op in ("CONTAINS", "NOT_CONTAINS"):
        hit = F.contains(a, lit(v))
        return ~hit if op == "NOT_CONTAINS" else hit
    if op == "STARTS_WITH":
        return F.startswith(a, lit(v))
    if op == "ENDS_WITH":
        return F.endswith(a, lit(v))
    if op == "REGEX_MATCH":
        try:
            re.compile(str(v))
        except re.error:
            return F.lit(False)
        return col.cast("string").rlike(("" if c.case_sensitive else "(?iu)") + str(v))
    if op in ("IN_LIST", "NOT_IN_LIST"):
        values = list(v) if isinstance(v, (list, tuple, set)) else [v]
        hit = reduce(lambda x, y: x | y, [a == lit(i) for i in values], F.lit(False))
        return ~hit if op == "NOT_IN_LIST" else hit
    return a == lit(v)


def _number(col: Column, c: Criterion) -> Column:
    op, v, a = c.operator, c.value, col.cast("double")
    near = lambda x: F.abs(a - F.lit(float(x))) < 1e-9
    try:
        if op == "BETWEEN":
            return a.between(float(v[0]), float(v[1]))
        if op in ("IN_LIST", "NOT_IN_LIST"):
            hit = reduce(lambda x, y: x | y, [near(i) for i in (v if isinstance(v, (list, tuple, set)) else [v])], F.lit(False))
            return ~hit if op == "NOT_IN_LIST" else hit
        if op in _COMPARE:
            return getattr(a, _COMPARE[op])(float(v))
        return ~near(v) if op == "NOT_EQUALS" else near(v)
    except (TypeError, ValueError, IndexError):
        return F.lit(False)


def _time(col: Column, c: Criterion) -> Column:
    def when(v):
        if isinstance(v, (dt.datetime, dt.date)):
            return F.lit(v).cast("timestamp_ntz")
        return F.try_to_timestamp(F.regexp_replace(F.lit(str(v)), "Z$", "")).cast("timestamp_ntz")

    a = (F.try_to_timestamp(F.regexp_replace(col, "Z$", "")) if c.kind == "temporal" else col).cast("timestamp_ntz")
    op, v = c.operator, c.value
    if op == "BETWEEN":
        if not isinstance(v, (list, tuple)) or len(v) < 2:
            return F.lit(False)
        return (a >= when(v[0])) & (a <= when(v[1]))
    if op in _COMPARE:
        return getattr(a, _COMPARE[op])(when(v))
    same = F.to_date(a) == F.to_date(when(v))
    return ~same if op == "NOT_EQUALS" else same


def compile(node: Criterion | Group | None, df: DataFrame) -> Column:  # noqa: A001
    """The Boolean Column of a filter tree on ``df``'s columns."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Group):
        if not node.members:
            return F.lit(True)
        parts = [compile(m, df) for m in node.members]
        if node.logic.upper() == "NOT":
            return ~parts[0]
        return reduce((lambda a, b: a | b) if node.logic.upper() == "OR" else (lambda a, b: a & b), parts)
    if node.operator not in OPERATORS:
        raise ValueError(f"no operator {node.operator}")
    col = _column(node, df)
    if node.operator == "IS_NULL":
        return col.isNull()
    if node.operator == "IS_NOT_NULL":
        return col.isNotNull()
    kind = df.select(col.alias("c")).dtypes[0][1]
    temporal = node.kind == "temporal" or kind.startswith(("timestamp", "date"))
    number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
    test = _time(col if not temporal or kind == "string" else col.cast("string"), node) if node.kind == "temporal" else _time(col, node) if temporal else _number(col, node) if number else col == F.lit(node.value) if kind == "boolean" else _text(col, node)
    return F.coalesce(test, F.lit(False))


def apply(df: DataFrame, node: Criterion | Group | None, min_score: float = 0.0, max_results: int | None = None, key: str | None = None) -> DataFrame:
    """Rows that pass; then those whose similarity (ranking, if it is 0) is at least ``min_score``; then the first ``max_results`` by ``key``."""
    out = df.where(compile(node, df))
    if min_score > 0:
        sim = F.coalesce(F.col("similarity_score"), F.lit(0.0)) if "similarity_score" in df.columns else F.lit(0.0)
        rank = F.coalesce(F.col("ranking_score"), F.lit(0.0)) if "ranking_score" in df.columns else F.lit(0.0)
        out = out.where(F.when(sim != 0, sim).otherwise(rank) >= min_score)
    if max_results:
        out = (out.orderBy(key) if key else out).limit(max_results)
    return out


def statistics(df: DataFrame, node: Criterion | Group | None) -> DataFrame:
    """F-33: one row of counts, in one pass."""
    leaves: list[Criterion] = []

    def walk(n):
        if isinstance(n, Group):
            for m in n.members:
                walk(m)
        elif n is not None:
            leaves.append(n)

    walk(node)
    counts = df.agg(F.count("*").alias("original_count"), F.count_if(compile(node, df)).alias("filtered_count"))
    ratio = F.coalesce(F.try_divide(F.col("filtered_count").cast("double"), F.col("original_count")), F.lit(0.0))
    kinds = F.array(*map(F.lit, sorted({c.kind for c in leaves}))) if leaves else F.array().cast("array<string>")
    return counts.select("*", ratio.alias("filter_ratio"), F.lit(len(leaves)).alias("n_filters"), kinds.alias("filter_types"))


# F-34, F-35: builders.
def content(value: str, operator: str = "CONTAINS") -> Criterion:
    return Criterion("content", operator, value, "content")


def metadata(name: str, value: Any, operator: str = "EQUALS") -> Criterion:
    return Criterion(f"metadata.{name}", operator, value)


def similarity(least: float) -> Criterion:
    return Criterion("similarity_score", "GREATER_EQUAL", least, "similarity")


def quality(least: float = 0.5) -> Criterion:
    return Criterion("quality", "GREATER_EQUAL", least, "quality")


def authority_at_least(least: float = 0.5) -> Criterion:
    return Criterion("authority", "GREATER_EQUAL", least, "authority")


def languages(*names: str) -> Criterion:
    return Criterion("language", "IN_LIST", list(names), "language")


def dates(name: str, start: Any = None, end: Any = None) -> Criterion | None:
    """Both bounds, one, or none (no criterion)."""
    if start is not None and end is not None:
        return Criterion(name, "BETWEEN", [start, end], "temporal")
    if start is None and end is None:
        return None
    return Criterion(name, "GREATER_EQUAL" if end is None else "LESS_EQUAL", start if end is None else end, "temporal")


def any_field(names: list[str], value: str) -> Group:
    return Group("OR", [Criterion(n, "CONTAINS", value) for n in names])


def validate(c: Criterion) -> list[str]:
    """What is wrong with a criterion; nothing for a sound one."""
    wrong = []
    if c.kind != "content" and not isinstance(c.field, Column) and not c.field:
        wrong.append("no field")
    if c.operator not in OPERATORS:
        wrong.append("unknown operator")
    if c.operator == "BETWEEN" and not (isinstance(c.value, (list, tuple)) and len(c.value) == 2):
        wrong.append("BETWEEN takes two values")
    if c.operator in ("IN_LIST", "NOT_IN_LIST") and not isinstance(c.value, (list, tuple, set)):
        wrong.append("a list is needed")
    return wrong


# F-36 ... F-40: filters around a search.
def search_level(least: float = 0.5, shortest: int | None = None, longest: int | None = None) -> Column:
    n = F.length("content")
    test = F.col("similarity_score") >= least
    test = test if shortest is None else test & (n >= shortest)
    return test if longest is None else test & (n <= longest)


def recent(day: Column, as_of: Column, days: int = 365) -> Column:
    """F-38: a missing date passes."""
    return F.coalesce(F.datediff(as_of, day) <= days, F.lit(True))


def missing_fields(**needed: Column) -> Column:
    """F-40: names of the needed columns that are null or empty."""
    found = F.array(*(F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in needed.items()))
    return F.filter(found, lambda n: n.isNotNull())
