"""Mixing sources to target weights by exact prefix cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.session import shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RESULTS = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """``source, source_size`` -> the same with ``target``.

    Sources in code-point order (null last) take the weights in turn and share
    ``share_pct`` per cent of all words. No target exceeds ``max_epochs`` times
    its source; the excess goes to the others by weight until none is above.
    That fixed point is found in one pass: by rising size per weight, a source
    is full if the level of those not yet full is above its own.
    """
    one = F.lit(1)
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy(one)
    rising = Window.partitionBy(one).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "budget": F.sum("source_size").over(every) * share_pct,
        "below": F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)),
    })
    # level = (budget - 100 * below) / (100 * rest); compared as w * level > cap without dividing
    s = s.withColumn("full", F.col("w") * (F.col("budget") - 100 * F.col("below")) > 100 * F.col("cap") * F.col("rest"))
    s = s.withColumns({"kept": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every), "open": F.sum(F.when(~F.col("full"),
        F.col("w")).otherwise(0)).over(every)})
    level = (F.col("w") * (F.col("budget") - 100 * F.col("kept"))).cast("double") / F.nullif(100 * F.col("open"), F.lit(0)).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2, seed: str = "mix", text: str = "text",
    source: str = "source", ident: str = "doc_id") -> DataFrame:
    """Say how many words of each document the mix takes.

    Adds ``size`` (words), ``source_size``, ``target`` and ``taken``; columns
    of those names are replaced. Each document has a random key, an MD5 of
    seed, id and text; leading bits of it range-partition each source into
    equal buckets, so even one source with most rows spreads over all tasks.
    Bucket totals give a prefix sum over the source, a window the sum inside
    the bucket. Whole epochs take every document; the rest takes the documents
    at the front, the last one in part, so that the source meets its target to
    the word.

    Null texts have size 0, a null source is a source of its own, null ids
    count as empty; equal rows have equal keys and are interchangeable; a very
    long text may be the one that is taken in part. Other columns are kept
    whatever their names; an empty table gives an empty result. Reruns agree.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    names = docs.columns
    bits = max(4, (shuffle_partitions(spark) * 4 - 1).bit_length())
    body, origin = docs[text], docs[source]
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(docs[ident].cast("string"), F.lit("")), F.lit("|"), F.coalesce(body, F.lit(""))).cast("binary"))
    keyed = docs.select(
        *[docs[c].alias(f"c{k}") for k, c in enumerate(names)],
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.coalesce(origin,
            F.lit("")).alias("s"), origin.isNull().alias("n"),
    )
    keyed = keyed.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    group = ["s", "n", "bucket"]

    totals = keyed.groupBy(*group).agg(F.sum("size").alias("words"))
    by_source = totals.groupBy("s", "n").agg(F.sum("words").alias("source_size"))
    aims = targets(by_source.select(F.when(~F.col("n"), F.col("s")).alias("source"), "source_size"), weights, share_pct, max_epochs)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), "source_size", "target")
    before = Window.partitionBy("s", "n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")).join(aims, ["s", "n"])

    inner = Window.partitionBy(*group).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("run", F.sum("size").over(inner)).join(starts, group)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("start") + F.col("run") - F.col("size"))))
    out = out.withColumn("taken", (epochs * F.col("size") + part).cast("long"))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *RESULTS)


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", **options) -> DataFrame:
    """The mix as rows: every document as often as it was taken, a part
    counting as a whole from half of its words on. Same columns as ``docs``,
    whatever their names; rows of a document follow no order.

    A document without words (null, empty, blank) is no training text and is
    left out. Repeated rows are documents like others; an empty table gives an
    empty result.
    """
    names = docs.columns
    rows = docs.select(*[docs[c].alias(f"in{k}") for k, c in enumerate(names)])
    at = {c: f"in{k}" for k, c in enumerate(names)}
    counted = mix(rows, text=at[text], source=at[source], ident=at[ident], **options)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    copies = counted.withColumn("times", times.cast("int")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*[F.col(at[c]).alias(c) for c in names])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as w from s),
r as (select *, sum(source_size) over () * 150 as budget,
      coalesce(sum(2 * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
      sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as rest from w),
f as (select *, w * (budget - 100 * below) > 200 * source_size * rest as is_full from r),
g as (select *, sum(case when is_full then 2 * source_size else 0 end) over () as kept, sum(case when is_full then 0 else w end) over () as open from f),
t as (select source, source_size, case when is_full then (2 * source_size)::double
      else least((w * (budget - 100 * kept))::double / nullif(100 * open, 0)::double, (2 * source_size)::double) end as target from g),
p as (select d.*, sum(size) over (partition by source order by k rows between unbounded preceding and current row) - size as pre from d),
x as (select p.*, t.source_size, t.target,
      case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as e
      from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, round(target - e * source_size)::bigint - pre)))::bigint as taken
from x
"""
