"""Vector metrics as expressions over array<double> columns (V-01 ... V-14).

Callers normalise first where the metric is to be read on unit vectors
(``normalise``); every metric is null-safe to 0 where it isn't defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "manhattan", "chebyshev", "pearson", "spearman", "dot", "angular")


def double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalise(v: Column) -> Column:
    """V-13: a zero vector stays as it is."""
    from .text import let

    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def cosine(a: Column, b: Column) -> Column:
    """V-01: 0 if either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """V-12."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclidean(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)))


def _centred(v: Column) -> Column:
    from .text import let

    return let(F.try_divide(total(v), F.size(v).cast("double")), lambda m: F.transform(v, lambda x: x - m))


def pearson(a: Column, b: Column) -> Column:
    return cosine(_centred(a), _centred(b))


def _ranks(v: Column) -> Column:
    """Average ranks, from 1."""
    below = lambda x: F.size(F.filter(v, lambda y: y < x))
    equal = lambda x: F.size(F.filter(v, lambda y: y == x))
    return F.transform(v, lambda x: below(x) + (equal(x) + 1) / 2)


def spearman(a: Column, b: Column) -> Column:
    return pearson(_ranks(a), _ranks(b))


def angular(a: Column, b: Column) -> Column:
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
    return F.lit(1.0) - F.acos(c) * 2 / F.lit(3.141592653589793)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """V-09, V-10: names without a formula of their own are cosine."""
    known = {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "pearson": pearson, "spearman": spearman, "dot": dot, "dot_product": dot, "angular": angular}
    return F.coalesce(known.get(metric, cosine)(a, b), F.lit(0.0))


def as_distance(score: Column) -> Column:
    """V-11."""
    return F.when(score <= 1, 1 - score).otherwise(F.lit(0.0))


def embedding_quality(v: Column, text: Column) -> Column:
    """V-14: within 0 and 1; 0 for blank text."""
    m = F.try_divide(total(v), F.size(v).cast("double"))
    var = F.try_divide(total(F.transform(v, lambda x: (x - m) * (x - m))), F.size(v).cast("double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), var * 10 + F.least(F.lit(1.0), F.length(text) / 100) * 0.3))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.0).otherwise(score)
