"""Distances as column expressions in double precision; smaller is nearer.

l2 is squared, ip is 1 - dot, cosine is 1 - cos.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument

METRICS = ("l2", "ip", "cosine")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def ip(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """NaN for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


l2.metric, ip.metric, cosine.metric = METRICS  # what search may take products for


def distance(metric: str) -> Callable[[Column, Column], Column]:
    if metric not in METRICS:
        raise InvalidArgument(f"metric must be one of {METRICS}, not {metric!r}")
    return {"l2": l2, "ip": ip, "cosine": cosine}[metric]


def sparse_dot(a_terms: Column, b_terms: Column) -> Column:
    """Of two maps from term to weight."""
    both = F.map_zip_with(a_terms, b_terms, lambda k, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return _total(F.map_values(both))


def maxsim(query: Column, document: Column, metric: str = "ip") -> Column:
    """Sum over query vectors of the least distance to a document vector. Cosine needs normalised vectors and ip."""
    if metric == "cosine":
        raise InvalidArgument("maxsim takes l2 or ip; normalise the vectors and use ip")
    d = distance(metric)
    return _total(F.transform(query, lambda t: F.array_min(F.transform(document, lambda u: d(t, u)))))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def denormalize(a: Column, n: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x.cast("double"), y.cast("double")))


def scale(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(a, lambda x: x.cast("double") * by)


def reduce_add(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x.cast("double")))


def bit_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def bit_not(a: Column) -> Column:
    """Within a byte."""
    return F.transform(a, lambda x: x.bitwiseXOR(F.lit(255)))
