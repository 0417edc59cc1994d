"""Joins that neither a hot key nor the size of a side can stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lettermill.session import shuffle_partitions


def with_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, other: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (null if there are none), which
    has one row for a key.

    ``weight`` is how many of the ``total`` rows have the key, so fewer than
    four for each partition are hot: these are broadcast, and their rows, like
    those of a null key, are dealt by ``other`` in the join of the rest. Of
    that a task holds its part of the facts, and the rows stream through unsorted.
    """
    parts, names = shuffle_partitions(rows.sparkSession), [c for c in facts.columns if c != key]
    hot = facts.where(F.col(weight) * (4 * parts) > total)
    rows = rows.join(F.broadcast(hot.withColumnsRenamed({c: f"hot_{c}" for c in names})), key, "left")
    apart = F.xxhash64(key, other)
    apart = F.concat(F.lit("\0"), apart.cast("string")) if isinstance(rows.schema[key].dataType, StringType) else apart
    cold = F.col(f"hot_{weight}").isNull() & F.col(key).isNotNull()
    rows = rows.withColumn("dealt", F.when(cold, F.col(key)).otherwise(apart)).join(facts.withColumnRenamed(key, "dealt").hint("shuffle_hash"), "dealt", "left")
    kept = [c for c in rows.columns if c not in names and c != "dealt" and not c.startswith("hot_")]
    mine = F.col("dealt") == F.col(key)
    return rows.select(*kept, *[F.coalesce(f"hot_{c}", F.when(mine, F.col(c))).alias(c) for c in names])
