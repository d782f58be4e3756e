"""Vector functions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sign_bits(a: Column) -> Column:
    """The places of positive components: a set that stands for the vector's signature."""
    return F.array_compact(F.transform(a, lambda x, i: F.when(x > 0, i)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of components."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def passing(faces: Column, least_similarity: float, least_area: float) -> Column:
    """Whether one and the same element of ``faces`` passes both limits (fields sim and area)."""
    return F.exists(faces, lambda f: (f["sim"] >= least_similarity) & (f["area"] >= least_area))


def largest(faces: Column, n: int = 1) -> Column:
    """The ``n`` elements with the largest area; ties in order."""
    ranked = F.transform(faces, lambda f, i: F.struct((-f["area"]).alias("k"), i.alias("i"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda x: x["f"])
