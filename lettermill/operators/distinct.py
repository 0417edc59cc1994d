"""One row per key, by preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[Column], rank: Column, **aggregates: Column) -> DataFrame:
    """The row with the smallest ``rank`` (an orderable column, such as a
    struct) of each group of equal ``keys``, nulls being equal, with
    ``aggregates`` of the group beside it.

    An aggregate, not a window: groups are reduced before the shuffle, so a key
    that most rows share costs no more than another.
    """
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    row = F.struct(*df.columns)
    picked = df.groupBy(*[k.alias(n) for n, k in named.items()]).agg(F.min_by(row, rank).alias("__row"), *[c.alias(n) for n, c in aggregates.items()])
    return picked.select("__row.*", *aggregates)


def newest_first(instant: Column) -> Column:
    """Ascending in this is descending in ``instant``, nulls first."""
    return F.struct(instant.isNotNull().alias("known"), (-F.unix_micros(instant.cast("timestamp"))).alias("age"))
