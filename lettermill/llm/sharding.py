"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.session import shuffle_partitions

BUCKETS_PER_PARTITION = 4


def bucket_of(value: Column, bounds: list[int], strict: bool) -> Column:
    """Number of sorted ``bounds`` at or below ``value`` (below it if ``strict``).

    Two levels keep the work per row at about 2 * sqrt(len(bounds)).
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fits = (lambda b: b < value) if strict else (lambda b: b <= value)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    full = F.size(F.filter(longs([b[-1] for b in blocks]), fits))
    inside = F.get(F.array(*[longs(b) for b in blocks]), full)
    return full * step + F.coalesce(F.size(F.filter(inside, fits)), F.lit(0))


def shard(docs: DataFrame, n_shards: int = 8, order_by: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut ``docs``, in the order of the integer column ``order_by``, into
    ``n_shards`` contiguous shards of nearly equal bytes.

    Adds ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``
    (position in the shard, gapless from 0); columns of those names are
    replaced, all other columns stay. Quantiles of ``order_by`` cut the rows
    into a few buckets per shuffle partition; bucket totals give each bucket's
    start in the global prefix sum; a window inside each bucket does the rest.
    A row goes to the shard that holds the middle byte of its stretch.

    Null ids sort first, null texts have size 1, equal ids are ordered by a
    hash of the text (an id that spans several quantiles is spread over their
    buckets by that hash), equal rows are interchangeable. A very long text is
    one row: no shard is closer to its share than its longest row allows. Other
    columns are kept whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    names = docs.columns
    ident = F.coalesce(docs[order_by].cast("long"), F.lit(-(2**63)))
    n = shuffle_partitions(spark) * BUCKETS_PER_PARTITION
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = docs.select(F.percentile_approx(ident, shares, max(10000, 50 * n)).alias("q")).first()["q"]
    bounds = sorted(found or [])
    keyed = docs.select(
        *[docs[c].alias(f"c{k}") for k, c in enumerate(names)],
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1).alias("size"), ident.alias("id"), F.xxhash64(docs[text]).alias("tie"),
    )
    low, high = bucket_of(F.col("id"), bounds, True), bucket_of(F.col("id"), bounds, False)
    keyed = keyed.withColumn("bucket", low + F.pmod(F.col("tie"), (high - low + 1).cast("long")).cast("int"))

    totals = keyed.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "bucket",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
        F.sum("bytes").over(whole).alias("total"),
    )
    inner = Window.partitionBy("bucket").orderBy("id", "tie")

    def placed(rows: DataFrame) -> DataFrame:
        run = rows.withColumns({"run": F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(inner)})
        run = run.join(F.broadcast(starts), "bucket")  # at most one row per bucket: n rows
        # F.expr of a bigint "div" keeps the cut exact where doubles would round
        return run.withColumn("middle", 2 * (F.col("byte0") + F.col("run")) - F.col("size")).withColumns(
            {"shard": F.least(F.expr(f"(middle * {n_shards}) div (2 * total)"), F.lit(n_shards - 1)).cast("int"), "pos": F.col("row0") + F.col("rn") - 1}
        )

    first = placed(keyed.select("bucket", "id", "tie", "size")).groupBy("shard").agg(F.min("pos").alias("first"))
    out = placed(keyed).join(F.broadcast(first), "shard")  # n_shards rows
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "size", "shard", (F.col("pos") - F.col("first")).cast("long").alias("slot"))


def op1_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = docs.withColumn("text_crc32", crc)
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its polynomial: a table of 256 remainders, and a fold over the bytes.
SQL = """
with step as (
  select n, list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) t(n)),
crc as (select list(v order by n) as t from step),
d as (
  select doc_id, coalesce(text, '') as x, strlen(coalesce(text, '')) + 1 as size from documents),
b as (
  select doc_id, size, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::bigint) as bytes from d),
c as (
  select doc_id, size,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(crc.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) as text_crc32
  from b, crc),
p as (
  select *, 2 * sum(size) over (order by doc_id) - size as middle, sum(size) over () as total from c),
s as (
  select *, least((middle * 8) // (2 * total), 7)::int as shard from p)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard
from s
"""
