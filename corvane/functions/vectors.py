"""Vector expressions, all in double precision, by higher-order functions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1, as the relational lane scores it."""
    return clamp01((cosine(a, b) + 1.0) / 2.0)


def pad(v: Column, width: int) -> Column:
    """Fill a shorter vector with zeros; a longer one is an error."""
    longer = F.raise_error(F.concat(F.lit("vector dimension "), F.size(v).cast("string"), F.lit(f" exceeds {width}"))).cast("array<float>")
    return F.when(F.size(v) <= width, F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(width) - F.size(v))))).otherwise(longer)


def to_literal(v: Column) -> Column:
    """[1.0,2.5]: the text form of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(s: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(s, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))


def valid(v: Column, dimension: int | None = None) -> Column:
    """Non-empty, finite numbers only, and of the expected dimension if one is given."""
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(ok & (F.size(v) == dimension) if dimension else ok, F.lit(False))
