"""Vector expressions over array<float> columns, in double precision, in order of the components."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine with one given vector, whose length is taken once. Null if either vector is null, has no length or the other
    has another number of components."""
    length = math.sqrt(math.fsum(float(x) * float(x) for x in query))
    if not length:
        return F.lit(None).cast("double")
    given = F.array(*[F.lit(float(x)) for x in query])
    return F.when(F.size(a) == len(query), dot(a, given) / F.nullif(norm(a) * F.lit(length), F.lit(0.0)))
