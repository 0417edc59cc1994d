"""Pages of a long sorted table by their place, without sorting it for each."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.session import new_path, shuffle_partitions

RANGE = "range_no"


@dataclass(frozen=True)
class Layout:
    """A table in ranges of ``order``, which follow one another: ``starts[k]``
    rows stand before range ``k``."""

    spark: SparkSession
    path: str
    schema: str
    order: list[Column]
    starts: list[int]

    def __len__(self) -> int:
        return self.starts[-1]

    def ranges(self, offset: int, limit: int) -> list[int]:
        """The ranges that hold rows of a page."""
        last = min(offset + limit, len(self))
        return [k for k, (a, b) in enumerate(zip(self.starts, self.starts[1:], strict=False)) if max(a, offset) < min(b, last)]

    def page(self, offset: int, limit: int) -> DataFrame:
        """The ``limit`` rows behind the first ``offset``, in order. Only the
        ranges that hold them are read and sorted, mostly one, however deep the page."""
        schema = StructType.fromJson(json.loads(self.schema))
        wanted = self.ranges(offset, limit)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{RANGE}={k}" for k in wanted])
        return rows.orderBy(*self.order).offset(offset - self.starts[wanted[0]]).limit(limit)


def lay_out(rows: DataFrame, order: list[Column], path: str | None = None, n_ranges: int | None = None) -> Layout:
    """Write ``rows`` in ranges of ``order``, whose columns must tell all rows
    apart for pages to be the same each time. The ranges come from a sample, so
    they differ in size, and their counts (a row a range) say exactly where each
    begins. Nulls stand where ``order`` puts them."""
    spark = rows.sparkSession
    path = path or new_path(spark, "pages")
    dealt = rows.repartitionByRange(n_ranges or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(path)
    have = spark.read.schema(StructType.fromDDL(f"{RANGE} int")).option("basePath", path).parquet(path)
    counts = {r[RANGE]: r["count"] for r in have.groupBy(RANGE).count().collect()}  # a row a range
    starts = [0]
    for k in range(max(counts, default=-1) + 1):
        starts.append(starts[-1] + counts.get(k, 0))
    return Layout(spark, path, rows.schema.json(), order, starts)
