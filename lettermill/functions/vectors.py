"""Vector arithmetic on array columns."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different lengths and for zero
    vectors, because a false similarity looks like any other number."""
    a, b = doubles(a), doubles(b)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    na, nb = total(F.transform(a, lambda x: x * x)), total(F.transform(b, lambda x: x * x))
    usable = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)


def cosine_to(a: Column, query: list[float]) -> Column:
    """As ``cosine`` with a constant, whose norm is taken once, here."""
    norm = math.sqrt(sum(float(x) * float(x) for x in query))
    if not norm:
        return F.lit(0.0)
    a = doubles(a)
    na = total(F.transform(a, lambda x: x * x))
    dot = total(F.zip_with(a, F.array(*[F.lit(float(x)) for x in query]), lambda x, y: x * y))
    return F.when((F.size(a) == len(query)) & (na > 0), dot / (F.sqrt(na) * norm)).otherwise(0.0)


def parsed_vector(text: Column) -> Column:
    """A vector from its JSON text; null if it is none."""
    return F.from_json(text, "array<double>")


def half_up(x, digits: int):
    """Rounded as Spark rounds: the shortest decimal form, halves away from zero."""
    import numpy as np

    out = np.round(x, digits)
    edge = np.flatnonzero(np.abs(np.abs(x * 10.0**digits) % 1 - 0.5) < 1e-6)
    for k in edge.tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out
