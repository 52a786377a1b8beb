"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty or unequal lengths and for zero vectors."""
    size = F.size(a)
    whole = F.coalesce((size == F.size(b)) & (size > 0), F.lit(False))
    score = F.try_divide(dot(a, b), F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)))
    return F.when(whole, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))


def parse_vector(text: Column, strict: bool = False) -> Column:
    """Comma-separated numbers to floats; a bad number is 0, or an error if ``strict``."""
    parts = F.split(text, ",")
    if strict:
        return F.transform(parts, lambda x: F.trim(x).cast("float"))
    return F.transform(parts, lambda x: F.coalesce(F.trim(x).try_cast("float"), F.lit(0.0).cast("float")))
