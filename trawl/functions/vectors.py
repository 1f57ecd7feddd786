"""Vector functions as Column expressions over arrays; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.schema import VECTOR_SIZES


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


DISTANCES = {"cosine": cosine_distance, "<=>": cosine_distance, "l2": l2_distance, "<->": l2_distance, "l1": l1_distance, "<+>": l1_distance}


def distance(name: str, a: Column, b: Column) -> Column:
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; one of {', '.join(DISTANCES)}")
    return DISTANCES[name](a, b)


def check_size(vector: list[float]) -> int:
    """The length of a query vector, if the segment store takes it."""
    if len(vector) not in VECTOR_SIZES:
        raise ValueError(f"vectors of {len(vector)} components are not stored; sizes are {VECTOR_SIZES}")
    return len(vector)


def resize(v: Column, size: int) -> Column:
    """Zero-padded or cut to size, without a new normalisation."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays. The length is bound once: named inside the inner function it would be computed anew for
    every component."""
    unit = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))
    return F.when(v.isNotNull(), F.get(unit, 0))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
