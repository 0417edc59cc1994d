"""Running totals over a whole table, in order, without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.session import durable, shuffle_partitions


def running_total(rows: DataFrame, order: str, amount: Column, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``amount`` over all rows before each
    in ascending ``order`` (nulls first; rows of equal ``order`` stand together
    and in any order among themselves).

    Ranges of ``order`` are written once, so a repeated task finds the same;
    the totals of the ranges, a row each, give every range's start.
    """
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.withColumns({"__amount": F.coalesce(amount, F.lit(0)).cast("double")}).repartitionByRange(n, order)
    dealt = durable(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__start"))
    inner = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("__run", F.coalesce(F.sum("__amount").over(inner), F.lit(0.0))).join(F.broadcast(starts), "__range")  # a row a range
    return run.select(*rows.columns, (F.col("__start") + F.col("__run")).alias(out))
