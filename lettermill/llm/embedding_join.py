"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import textbytes as tb
from lettermill.llm.joins import with_facts
from lettermill.operators.components import connected_components
from lettermill.session import durable, ship

THRESHOLD = 0.95
MAX_PIVOTS = 4096
CHUNK = 4096
SLICE = 256
EXACT_ROWS = 1 << 15
SLACK = 1e-5


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, shorter ones padded with zeros, and their lengths."""
    lens = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(lens.max(initial=0)), width or 0)
    if (lens == width).all():
        return flat.reshape(len(lens), width), lens
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out, lens


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(1, keepdims=True, initial=0.0), 1e-300)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def radius(threshold: float) -> float:
    """The chord between unit vectors at this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ pivots.T)))


def screen(width: int) -> float:
    """How far a cosine in single precision can be from the true one: each of
    ``width`` products and sums, and the rounded numbers themselves, err by
    2**-24 of at most one."""
    return max(SLACK, 1.1 * (width + 4) * 2.0**-24)


def compare(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions of unit rows ``a`` and ``b``: screened in single, decided in double precision."""
    af, bf, least = a.astype(np.float32), b.astype(np.float32), threshold - screen(a.shape[1])
    for at in range(0, len(a), SLICE):
        i, j = np.nonzero(af[at : at + SLICE] @ bf.T >= least)
        i += at
        ok = len_a[i] == len_b[j]
        i, j = i[ok], j[ok]
        parts = [np.einsum("ij,ij->i", a[i[k : k + EXACT_ROWS]], b[j[k : k + EXACT_ROWS]]) >= threshold for k in range(0, len(i), EXACT_ROWS)]
        ok = np.concatenate([np.zeros(0, bool), *parts])
        yield i[ok], j[ok]


def join_cell(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one cell's chunk of homes with one block of visitors: for every
    vector the weight of its partners, and a spanning forest of the links."""
    table = table.combine_chunks()
    column = table.column("emb").combine_chunks()
    m, lens = matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    u = unit(m)
    cid, n, home = (table.column(c).to_numpy() for c in ("cid", "n", "home"))
    h, v = np.flatnonzero(home), np.flatnonzero(~home.astype(bool))
    weight, forest = np.zeros(len(cid), np.int64), [np.zeros((2, 0), np.int64)]

    def add(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(weight, x, n[y])
        np.add.at(weight, y, n[x])
        label = tb.spanning(x, y, len(cid))
        moved = np.flatnonzero(label != np.arange(len(cid)))
        forest.append(np.stack([moved, label[moved]]))

    for i, j in compare(u[h], u[v], lens[h], lens[v], threshold):
        add(h[i], v[j])
    if len(h) and table.column("block")[0].as_py() == 0:
        for i, j in compare(u[h], u[h], lens[h], lens[h], threshold):
            add(h[i[i < j]], h[j[i < j]])
    x, y = np.concatenate(forest, axis=1)
    label = tb.spanning(x, y, len(cid))
    moved, linked = np.flatnonzero(label != np.arange(len(cid))), np.flatnonzero(weight)
    return pa.table({
        "a": np.r_[cid[linked], cid[moved]],
        "b": pa.array(np.r_[np.zeros(len(linked), np.int64), cid[label[moved]]], mask=np.r_[np.ones(len(linked), bool), np.zeros(len(moved), bool)]),
        "n": np.r_[weight[linked], np.zeros(len(moved), np.int64)],
    })


def range_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``cid, n, emb`` -> ``a, b, n``: weights of partners (``b`` null) and linking edges.

    A few vectors, chosen by hash, are pivots; every vector belongs to the cell
    of its nearest. By the triangle inequality a vector within r of one whose
    home is cell i has d(x, p_i) at most d(x, own pivot) + 2 r, and at most the
    cell's radius + r; it visits the cells of smaller number that pass both.
    Chunks of a cell's homes meet blocks of its visitors in groups of bounded
    size, so neither a hot cell nor many visitors fill one task.
    """
    spark = classes.sparkSession
    ship(spark)
    count = classes.count()
    wanted = max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(count) / 8)))
    rows = classes.orderBy(F.xxhash64("emb"), "cid").limit(wanted).select("emb").collect()  # at most MAX_PIVOTS
    width = max((len(r["emb"]) for r in rows), default=1)
    width = max(width, classes.agg(F.max(F.size("emb")).alias("w")).first()["w"] or 1)
    pivots = np.zeros((max(len(rows), 1), width))
    for k, r in enumerate(rows):
        pivots[k, : len(r["emb"])] = r["emb"]
    shared = spark.sparkContext.broadcast(unit(pivots))
    r = radius(threshold)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(unit(matrix(batch.column("emb"), width)[0]), shared.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], ["cell", "d"])

    cells = tb.map_arrow(classes.select("emb"), assign, "cell int, d double").groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()  # a row a pivot
    reach, chunks = np.full(len(pivots), -1.0), np.ones(len(pivots), np.int64)
    for c in cells:
        reach[c["cell"]], chunks[c["cell"]] = c["radius"] + r, -(-c["n"] // CHUNK)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(unit(matrix(batch.column("emb"), width)[0]), shared.value)
            cell = d.argmin(1)
            near = (d <= d[np.arange(len(cell)), cell][:, None] + 2 * r) & (d <= reach) & (np.arange(len(reach)) < cell[:, None])
            row, to = np.nonzero(near)
            offsets = np.r_[0, np.cumsum(near.sum(1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(to,
                pa.int32()))], [*batch.schema.names, "cell", "visits"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    placed = durable(tb.map_arrow(classes, visit, StructType([*classes.schema.fields, StructField("cell", IntegerType()), StructField("visits",
        ArrayType(IntegerType()))])), "cells")
    guests = {c["to"]: c["n"] for c in placed.select(F.explode("visits").alias("to")).groupBy("to").agg(F.count("*").alias("n")).collect()}
    blocks = [max(1, -(-(guests.get(k, 0) + (CHUNK if c > 1 else 0) * int(c - 1)) // CHUNK)) for k, c in enumerate(chunks.tolist())]
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    n_chunks, n_blocks = ints(chunks), ints(blocks)
    own = F.col("cell")
    mark = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)).cast("int")
    placed = placed.withColumns({"chunk": F.pmod(mark, F.get(n_chunks, own)), "mark": F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 20)).cast("int")})
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at_home = F.transform(upto(F.get(n_blocks, own)), lambda b: F.struct(own.alias("cell"), F.col("chunk").alias("chunk"), b.alias("block"),
        F.lit(True).alias("home")))
    beside = F.when(F.col("chunk") > 0, F.transform(upto(F.greatest(F.col("chunk"), F.lit(1))), lambda m: F.struct(own.alias("cell"),
        m.alias("chunk"), F.pmod(F.col("mark"), F.get(n_blocks, own)).alias("block"), F.lit(False).alias("home"))))
    abroad = F.flatten(F.transform("visits", lambda c: F.transform(upto(F.get(n_chunks, c)), lambda m: F.struct(c.alias("cell"), m.alias("chunk"),
        F.pmod(F.col("mark"), F.get(n_blocks, c)).alias("block"), F.lit(False).alias("home")))))
    kind = "array<struct<cell:int,chunk:int,block:int,home:boolean>>"
    seats = F.concat(at_home.cast(kind), F.coalesce(beside.cast(kind), F.array().cast(kind)), abroad.cast(kind))
    groups = placed.select("cid", "n", "emb", F.explode(seats).alias("s")).select("cid", "n", "emb", "s.*")
    return groups.groupBy("cell", "chunk", "block").applyInArrow(lambda t: join_cell(t, threshold), "a long, b long, n long")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``; columns of
    those names are replaced.

    Pairs with a cosine (double precision) of ``threshold`` or more link.
    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths. Equal vectors are
    joined once, with their number as weight, so copies never become pairs.
    ``component_id`` is the smallest id reachable by links; rows of one id are
    kept or not together; a null id is never kept unless its vector is alone.
    Repeated rows link like others, ties need no order, and very long vectors
    are only wide. Other columns are kept whatever their names. An empty table
    gives an empty result.
    """
    vectors = vectors.drop("n_links", "component_id", "kept")
    names, vec = vectors.columns, vectors[vector]
    good = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    emb = F.when(good, vec)
    # 128 bits stand for a vector, so that only the join of cells moves vectors
    key = F.when(good, F.concat_ws(".", F.hex(F.xxhash64(vec)), F.hex(F.xxhash64(F.lit(1), vec))))
    rows = vectors.select(*[vectors[c].alias(f"c{k}") for k, c in enumerate(names)], vectors[ident].alias("id"), key.alias("key"),
        F.monotonically_increasing_id().alias("at"))
    classes = vectors.select(key.alias("key"), emb.alias("emb"), vectors[ident].alias("id")).where("key is not null")
    classes = classes.groupBy("key").agg(F.first("emb").alias("emb"), F.count("*").alias("n"), F.min("id").alias("least"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    links = durable(range_links(classes.select("cid", "n", "emb"), threshold), "links")
    degree = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    parts = connected_components(links.where("b is not null").select("a", "b"))
    named = classes.select("key", "n", "least", "cid").join(parts.select(F.col("node").alias("cid"), "component"), "cid",
        "left").withColumn("component", F.coalesce("component", "cid"))
    ends = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ends, "component").join(degree, "cid", "left")
    named = durable(named.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "groups")
    out = with_facts(rows, named, "key", "n", vectors.count(), "at")
    alone = F.col("n").isNull()
    return out.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_groups(vectors).select("vec_id", "n_links", "component_id", "kept")


SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
r(n, m) as (select vec_id, vec_id from embeddings union select r.n, p.b from r join p on p.a = r.m),
c as (select n, min(m) as component_id from r group by n),
d as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(d.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.n = e.vec_id left join d on d.a = e.vec_id
"""
