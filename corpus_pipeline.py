"""A training corpus in five stages: language, near-copies, benchmark leaks,
mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import decontaminate, langid, mixing, sharding, simhash
from lettermill.session import durable

MIN_SHARE = 0.5
N_SHARDS = 8


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and each column's new name."""
    at = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in at.items()]), at


def put_back(rows: DataFrame, at: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in at.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one main language; those without letters (null, empty and
    blank texts are such), and those of which no language has ``MIN_SHARE`` of
    the words, go. The model is fitted on the labelled documents. Repeated rows
    stay or go together; ties, very long texts and empty tables are as in
    ``langid.identify``; columns are kept whatever their names."""
    rows, at = aside(docs)
    rows = langid.identify(rows, langid.fit(rows, at["text"], at["lang"]), at["text"])
    return put_back(rows.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SHARE)), at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of the smallest id.
    Two are near-copies by op5's method (SimHash fingerprints of three-word
    shingles within 3 bits, found by pigeonring), or if their five-word shingles
    are 0.8 similar or more, which edits soon take beyond those bits. Nulls, ties,
    repeated rows, very long texts and empty tables are as in ``simhash.near_copy_dedup``."""
    return simhash.near_copy_dedup(docs, ring=simhash.RING)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none, and
    stay; repeated rows stay or go together; very long texts are read whole;
    columns are kept whatever their names; an empty table gives an empty one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, at = aside(docs)
    return put_back(decontaminate.find_leaks(rows, items, at["text"]).where(F.size("leaks") == 0), at)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them. A null source is
    a source; documents without words (null, empty, blank) go; repeated rows
    are documents like others; ties are broken by hashes; a very long text may
    be the one taken in part, which counts as a whole from half its words on;
    an empty table gives an empty one."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``size``, shard and slot in it; columns of these
    names are replaced. Nulls, ties, repeated rows, very long texts and empty
    tables are as in ``sharding.shard``."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mixture", mixture), ("shards", shards)]

#: SQL expresses neither the language model nor fingerprints; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
