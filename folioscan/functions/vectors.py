"""Vector expressions on array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 for the same direction, 2 for the opposite one; NULL if a side is NULL or all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, F.lit(1.0) - dot(a, b) / scale)


def unit_dot(a: Column, b: Column) -> Column:
    """Similarity of unit vectors; 0 when a side is empty or the lengths differ."""
    usable = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(usable, F.lit(False)), dot(a, b)).otherwise(F.lit(0.0))


def cosine_safe(a: Column, b: Column) -> Column:
    """True cosine, 0 when a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def parse_vector(text: Column) -> Column:
    """``"[0.1, 0.2]"`` to an array of doubles; anything unreadable gives an empty array."""
    empty = F.array().cast("array<double>")
    body = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    values = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(text.isNull() | F.exists(values, lambda v: v.isNull()), empty).otherwise(values)


def parse_items(items: Column) -> Column:
    """Array of number texts to an array of doubles; empty if one of them is unreadable."""
    empty = F.array().cast("array<double>")
    values = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(items.isNull() | F.exists(values, lambda v: v.isNull()), empty).otherwise(values)


def has_dimension(embedding: Column, dimension: int) -> Column:
    return F.coalesce(F.size(embedding) == dimension, F.lit(False))


def embed_input(content: Column, limit: int | None = None) -> Column:
    """The text handed to an embedding model: whole, or cut to the length the model accepts."""
    return content if limit is None else F.substring(content, 1, limit)
